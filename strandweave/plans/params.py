"""Parameters of the registered queries."""

K = 30  # length of a k-mer
H, E = 75, 0.15  # shortest overlap and greatest share of mismatches: half of and 15 % of 150 bases
MAX_COV = 20  # k-mers seen 3 * MAX_COV times or more are repeats
SMOOTHING = 0.001  # added to the entries of the confusion table, which are shares; 1 is added to counts
COV = 12  # coverage for prior votes
MAX_VOTES, MIN_VOTES = 40, 1
H_RATE = 0.001  # share of heterozygous columns where both alleles are called
DEGREE, BIN = 5, 50  # caps of the adjacency and index formats
SUBSET = 0.1  # share of the reads in the model-selection subset
