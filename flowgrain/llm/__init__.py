"""Operators for training text: deduplicated functions, defective labels, documented functions, tokens, packing, residue."""
