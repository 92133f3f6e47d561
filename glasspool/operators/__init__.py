"""Building blocks shared by the analyses: joins, slices, ranks, graph and quality operators."""
