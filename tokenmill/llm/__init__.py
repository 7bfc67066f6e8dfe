"""Operations of a large training-data pipeline, each a Spark job.

Nothing else in the library imports this subpackage. Modules:

``topk`` bit-sliced exact top-k; ``lm`` backoff-automaton scoring; ``wavelet``
token files; ``toxicity`` ordinal regression; ``suffix`` difference-cover
substring removal; ``setjoin`` n-gram Jaccard join; ``bpe`` byte-pair
encoding; ``exact`` binary-fuse exact dedup; ``packing`` cutting-stock
packing; ``urls`` URL verdicts; ``spelling`` spelling variants; ``phrases``
collocations; ``rankbpe`` byte-pair encoding by rank files. ``queries`` registers one query for each.
"""
