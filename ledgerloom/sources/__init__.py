"""Readers and writers: listings, report files, prices, model folders."""
