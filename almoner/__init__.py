"""Almoner: a PySpark-native analytics library for gifts, projects, words and posts."""
