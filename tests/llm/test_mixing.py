"""Mixes against their targets, sizes against the tokenizer library."""

import collections
import random

from lanternlog.llm import mixing, words
from lanternlog.session import Tables


def test_apportionment():
    order = mixing.apportion({"a": 0.53, "b": 0.24, "c": 0.23}, 7)
    assert collections.Counter(order) == {"a": 3, "b": 2, "c": 2}  # the textbook case of odd divisors
    assert mixing.apportion({}, 5) == [] and mixing.apportion({"a": 0.0}, 5) == []


def mixed(spark, docs, targets, **options):
    sized = Tables(spark, "t").put(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"))
    out, shares = mixing.mix(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **options)
    return out.collect(), {r.source: r for r in shares.collect()}


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["big"] * 10 + ["small", "tiny", None]), rng.randint(0, 40)) for i in range(4000)]
    out, shares = mixed(spark, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 3), ("none", 0.1, 1)], blocks=200, buckets=16)
    total = sum(r.n_tokens for r in out)
    used = collections.Counter(r.doc_id for r in out)
    source = {i: s for i, s, _ in docs}
    for name, share, most in (("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 3)):
        got = sum(r.n_tokens for r in out if r.source == name) / total
        assert abs(got - share) < 0.01 and abs(shares[name].actual_share - got) < 1e-9
        assert max(n for d, n in used.items() if source[d] == name) <= most
    assert shares["none"].n_tokens == 0 and all(source[r.doc_id] == r.source for r in out)
    assert len({(r.doc_id, r.copy_no) for r in out}) == len(out)
    again, _ = mixed(spark, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.2, 3)], blocks=200, buckets=16)
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mix_of_nothing(spark):
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []
    assert mixed(spark, [(1, "a", 0), (2, None, 5)], [("a", 1.0, 2)])[0] == []


def test_words_follow_the_pattern():
    import regex

    pattern = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
    rng = random.Random(7)
    texts = ["".join(rng.choice("a b'stre  lvm\n\té1٣!?' '中 \xa0　ll") for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    joined, starts, per = words.split(texts)
    pieces, at = words.pieces(joined, starts), 0
    for text, n in zip(texts, per.tolist()):
        assert pattern.findall(text) == pieces[at : at + n]
        at += n
    assert words.split([])[0] == "" and words.split(["", ""])[2].tolist() == [0, 0]


def test_sizes_equal_the_tokenizer():
    import base64

    import tiktoken

    from lanternlog.llm import sizes

    encoding = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=sizes.ranks(sizes.VOCABULARIES, sizes.NAME), special_tokens={})
    texts = ["", "hello  world's end\n\n", "<|endoftext|>", "ü中文 " * 50, base64.b64encode(bytes(range(256))).decode()]
    assert sizes.Sizer()(texts).tolist() == [len(encoding.encode_ordinary(t)) for t in texts]
