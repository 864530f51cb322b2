"""Operators for preparing training corpora: deduplication at several grains,
filtering, extraction, mixing and packing. Nothing else in the library imports
this folder."""
