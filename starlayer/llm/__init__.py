"""Operators of a training-data pipeline: language, quality, toxicity, chat
formatting, mixing, near-duplicates, packing, sharding and token files.

Every operator takes DataFrames and parameters and returns a DataFrame;
``queries`` applies each with production parameters to whole tables.
"""
