"""Schemas: donations (18 columns), projects (30), posts; and where each field lies in the raw CSV lines.

Dates, coordinates and t/f flags stay strings, and a missing value is "" (numbers: 0), never NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Names, types and positions of the input's fields.
DONATION_FIELDS = [
    ("donation_id", 0, "string"), ("project_id", 1, "string"), ("donor_city", 4, "string"), ("donor_state", 5, "string"),
    ("donor_is_teacher", 7, "string"), ("ddate", 8, "string"), ("amount", 9, "float"), ("support", 10, "float"), ("total", 11, "float"),
    ("payment_method", 14, "string"), ("payment_inc_acct_credit", 15, "string"), ("payment_inc_campaign_gift_card", 16, "string"),
    ("payment_inc_web_gift_card", 17, "string"), ("payment_promo_matched", 18, "string"), ("via_giving_page", 19, "string"),
    ("for_honoree", 20, "string"), ("thank_you_packet", 21, "string"), ("message", 22, "string"),
]
DONATION_RAW_COLUMNS = 23

PROJECT_FIELDS = [
    ("project_id", 0, "string"), ("teacher_acctid", 1, "string"), ("school_id", 2, "string"), ("school_latitude", 4, "string"),
    ("school_longitude", 5, "string"), ("school_city", 6, "string"), ("school_state", 7, "string"), ("school_country", 11, "string"),
    ("teacher_prefix", 18, "string"), ("primary_focus_subject", 21, "string"), ("primary_focus_area", 22, "string"),
    ("secondary_focus_subject", 23, "string"), ("secondary_focus_area", 24, "string"), ("resource_type", 25, "string"),
    ("poverty_level", 26, "string"), ("grade_level", 27, "string"), ("vendor_shipping_charges", 28, "float"), ("sales_tax", 29, "float"),
    ("payment_processing_charges", 30, "float"), ("fulfillment_labor_materials", 31, "float"),
    ("total_price_excluding_opt_donation", 32, "float"), ("total_price_including_opt_donation", 33, "float"),
    ("students_reached", 34, "int"), ("total_donations", 35, "int"), ("num_donors", 36, "int"), ("funding_status", 39, "string"),
    ("date_posted", 40, "string"), ("date_completed", 41, "string"), ("date_thank_you_packet_mailed", 42, "string"), ("date_expiration", 43, "string"),
]
PROJECT_RAW_COLUMNS = 44

_TYPES = {"string": T.StringType(), "float": T.FloatType(), "int": T.IntegerType()}
DONATIONS = T.StructType([T.StructField(n, _TYPES[t]) for n, _, t in DONATION_FIELDS])
PROJECTS = T.StructType([T.StructField(n, _TYPES[t]) for n, _, t in PROJECT_FIELDS])
POSTS = T.StructType([T.StructField(n, T.StringType()) for n in ("username", "creation", "content")])

#: The 17-column compatibility view leaves this donations column out.
COMPAT_OMITS = "for_honoree"
COMPAT_COLUMNS = [n for n, _, _ in DONATION_FIELDS if n != COMPAT_OMITS]

#: Column projections that the joins carry.
DONATION_PROJECTION = ["donation_id", "project_id", "ddate", "donor_city", "total"]
PROJECT_PROJECTION = ["project_id", "school_city", "poverty_level", "primary_focus_subject"]
