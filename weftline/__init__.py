"""A Spark library for chromosome-contact data: alignments, concatemers, pairs, contacts, depth, pruning and ordering."""
