"""The suffix tree over words: contexts reach across words and are kept by a count that doesn't depend on the corpus."""

import math
from collections import Counter, defaultdict

from lanecast.llm import lm_score

TEXTS = ["red stone bird"] * 40 + ["blue stone fish"] * 40 + [f"filler w{k % 37} w{k % 11} end" for k in range(300)] + ["", None]


def brute(training, text, least=lm_score.LEAST, prior=lm_score.PRIOR, divergence=lm_score.DIVERGENCE):
    symbols = lambda t: ["<", "<", *(t or "").lower().split(), ">"]
    after = [defaultdict(Counter) for _ in range(3)]
    for t in training:
        s = symbols(t)
        for k in range(2, len(s)):
            for d in range(3):
                after[d][tuple(s[k - d : k])][s[k]] += 1
    root = after[0][()]
    n, v = sum(root.values()), len(root)

    def p(context, c):
        if not context:
            return (root[c] + 1) / (n + v + 1)
        seen = after[len(context)].get(context, {})
        total = sum(seen.values())
        below = p(context[1:], c)
        return (seen.get(c, 0) + prior * below) / (total + prior) if total >= least else below

    def retained(context):
        seen = after[len(context)].get(context, {})
        total = sum(seen.values())
        return not context or total >= least and sum(m * math.log2((m - 1 + prior * p(context[1:], c)) / (total - 1 + prior) / p(context[1:], c)) for c, m in seen.items()) / total >= divergence

    out, s = 0.0, symbols(text)
    for k in range(2, len(s)):
        context = next(x for x in (tuple(s[k - d : k]) for d in (2, 1, 0)) if retained(x))
        out += math.log10(p(context, s[k]))
    return out


def test_scores_equal_brute_force(spark):
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    asked = ["red stone bird", "red stone fish", "filler w3 w3 end", "stone W1 unheard", "", None]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for block, shard in ((lm_score.BLOCK, lm_score.SHARD), (300, 100), (50, 40)):  # one of each; many; contexts dealt over shards
        got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, train, block=block, shard=shard).collect()}
        assert len(got) == len(asked) and all(abs(got[k] - brute(TEXTS, t)) < 1e-9 for k, t in enumerate(asked))


def test_a_word_depends_on_the_word_before_the_last(spark):
    train = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs = spark.createDataFrame([(0, "red stone bird"), (1, "blue stone fish"), (2, "red stone fish"), (3, "blue stone bird")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in lm_score.score(docs, train).collect()}
    assert s[0] + s[1] > s[2] + s[3] + 1


def test_a_context_is_kept_in_a_large_corpus(spark):
    """20 occurrences among more than 1 / 3e-5 times as many symbols."""
    filler = " ".join(f"w{k % 997}" for k in range(200_000))
    train = spark.createDataFrame([(0, filler)] * 4 + [(k, "left turn") for k in range(20)], "doc_id long, text string")
    docs = spark.createDataFrame([(0, "left turn"), (1, "turn left")], "doc_id long, text string")
    s = {r["doc_id"]: r for r in lm_score.score(docs, train).collect()}
    assert s[0]["base_score"] == s[1]["base_score"] and s[0]["score"] > s[1]["score"] + 4
