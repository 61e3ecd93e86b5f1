"""Operators for preparing training data: packing, mixing, near duplicates, fingerprints, WARC, licences, chat."""
