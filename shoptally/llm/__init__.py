"""Operators of a training-data pipeline (line dedup, tokenising, URL lists,
decontamination, license and secret scans, sharding, quality rules, chat
formatting, n-gram joins). Nothing outside this subpackage imports it."""
