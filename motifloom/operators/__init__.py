"""Operators on nodes, pairs, edges, partitions and motifs."""
