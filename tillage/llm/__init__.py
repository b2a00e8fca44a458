"""Operators of a training-data pipeline over documents, pages and embeddings.

tokens           word-memoised tokenisation with a public vocabulary (used by huffman, packing)
huffman          1  canonical length-limited Huffman files of token ids
mixing           2  hierarchical budgets and seeded token prefixes (DataFrame functions only)
html_cut         3  main text of web pages by minimum cut
ngram_join       4  n-gram Jaccard join with Bayesian pruning of MinHash candidates
block_naming     5  exact duplicates by recursive block naming
pivot_index      6  exact top-k inner products with a pivot-distance index
bloom_cascade    7  URL rules and exact list membership by a Bloom filter cascade
packing          8  best-fit packing certified by dual feasible functions
secret_ledger    9  secret scans kept in a ledger of text blobs
toxicity         10 FTRL-proximal logistic regression on hashed n-grams
infilling        11 fill-in-the-middle with counted possessive groups of one pattern per row
ranked_search    12 ranked lexical search by NRA over impact-sorted lists
slots            13 shards through virtual slots and a versioned map (DataFrame functions only)
catalog          the registered queries op1_ ... op13_ and their DuckDB statements

Nothing else in the library imports this sub-package.
"""
