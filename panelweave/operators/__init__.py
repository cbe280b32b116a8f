"""Reusable table operators: reshaping, keys, ranks, descriptions, imputation, models."""
