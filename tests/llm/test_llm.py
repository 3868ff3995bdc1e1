"""Text and pair operators against brute force, exact round trips and held-out accuracy."""

import collections
import datetime as dt
import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanternlog.llm import groups, languages, lookalikes, mojibake, runs, tokens

T0 = dt.datetime(2025, 1, 1)

# ---- wrong encodings ----

CLEAN = ["Prüfprotokoll", "größe", "señal", "año", "копия", "журнал", "źródło", "łącze", "été", "dépôt", "påmelding", "日報", "ação", "città"]


def damage(word, written, read):
    try:
        raw = word.encode(written)
        return "".join(c if c != "�" else chr(b) for b, c in zip(raw, (bytes([b]).decode(read, "replace") for b in raw))) if read not in mojibake.MANY_BYTES else raw.decode(read)
    except UnicodeError:
        return None


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman"])
def test_every_utf8_damage_has_its_candidate(read):
    for word in CLEAN:
        once = damage(word, "utf-8", read)
        assert word in {r for _, r in mojibake.candidates(once)}
    twice = damage(damage("größe", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert "größe" in {r for _, r in mojibake.candidates(twice)}


def test_fit_finds_and_restores(spark):
    rng = random.Random(3)
    rows, truth = [], {}
    chains = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("cp1252", "cp437"), ("utf-8", "gbk"), ("cp1250", "cp1252")]
    for i in range(1500):
        word = rng.choice(CLEAN)
        text = f"C:\\jobs\\{rng.choice('abc')}_{word}.txt"
        if rng.random() < 0.06:
            bad = damage(word, *rng.choice(chains))
            if bad and bad != word and mojibake.shown(bad.replace("\x81", "x")):
                truth[i] = text
                text = text.replace(word, bad)
        rows.append((i, "f", text))
    extra = ["", None, "plain", "GRÖSSE.txt", "gr\ufffd\ufffde.txt", "Windοws", "exе", "ＡＢＣ", "x" * 50_000, "ü" * 20_000]
    rows += [(9000 + i, "f", t) for i, t in enumerate(extra)]
    values = spark.createDataFrame(rows, "row_id long, field string, text string")
    state = mojibake.fit(values)
    found = {r.rid for r in mojibake.found(values, state).collect()}
    lost = 9000 + extra.index("gr\ufffd\ufffde.txt")
    assert lost in found and not {r for r in found if r >= 9000} - {lost}
    hits = {r for r in found if r < 9000}
    assert len(hits & set(truth)) >= 0.95 * len(truth) and len(hits - set(truth)) <= 0.02 * len(truth)
    restored = {r.row_id: r.repaired for r in mojibake.repair(values, state).collect()}
    right = sum(restored[i] == truth[i] for i in hits & set(truth))
    assert right >= 0.95 * len(hits & set(truth))


def test_no_damage(spark):
    values = spark.createDataFrame([(1, "f", "größe"), (2, "f", None), (3, "f", "abc")], "row_id long, field string, text string")
    assert mojibake.found(values, mojibake.fit(values)).count() == 0
    assert mojibake.found(values.limit(0), mojibake.fit(values.limit(0))).count() == 0


# ---- groups ----


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in parent}


@pytest.mark.parametrize("shape", ["random", "star and chains", "one chain"])
def test_groups_equal_union_find(spark, shape):
    rng = random.Random(shape)
    if shape == "random":
        pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    elif shape == "star and chains":
        order = rng.sample(range(1, 400), 300)
        pairs = [(500, order[i]) for i in range(60)] + [(order[i], order[i + 1]) for i in range(59, 200)] + [(order[i], order[i + 1]) for i in range(210, 290)]
    else:
        pairs = [(i, i + 1) for i in range(200)]
    noise = [(None, 3), (5, None), (7, 7), (3, 10_000), None and (0, 0)]
    df = spark.createDataFrame([p for p in pairs + pairs[::3] + [(b, a) for a, b in pairs[::2]] + noise if p], "a long, b long")
    ids = spark.range(1000).select(F.col("id"), F.lit(1).alias("group_id"))
    got = groups.components(groups.edges_of(df, "a", "b", ids)).collect()
    assert {(r.id, r.group_id) for r in got} == union_find([(a, b) for a, b in pairs if a != b]) and len(got) == len({r.id for r in got})


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert groups.components(groups.edges_of(df, "a", "b")).count() == 0


# ---- look-alikes ----


def test_forms():
    same = [
        ["Add member - role", "Ａｄｄ　ｍｅｍｂｅｒ　－　ｒｏｌｅ", "Add\xa0member\u2007–\u2009role", "A\u200bdd\ufeff mem\xadber - role\u2060", "Аdd mеmbеr - rоlе", "Αdd member - rοle"],
        ["Résumé export", "Re\u0301sume\u0301 export", "Résumé eⅹport"], ["ユーザー", "ﾕｰｻﾞｰ", "ユーサ\u3099ー"], ["office", "oﬃce"], ["Clé d'accès", "Clé d’accès", "Clé d＇accès"], ["Сброс", "Cбpoc"],
    ]
    forms = [set(lookalikes.consistent_texts(pa.array(g)).to_pylist()) for g in same]
    assert all(len(f) == 1 for f in forms) and len({next(iter(f)) for f in forms}) == len(same)
    apart = lookalikes.consistent_texts(pa.array(["Resume", "Résumé", "resume", "Resumé", "ano", "año", "", None, "x" * 100_000])).to_pylist()
    assert len(set(apart)) == 8 and apart[6] == apart[7] == ""


def test_forms_don_t_depend_on_normalisation():
    rng = random.Random(2)
    marks = "\u0301\u0323\u0308\u0302\u0327\u3099"
    texts = ["".join(rng.choice("eoaEọệéカẦx각" + marks) for _ in range(9)) for _ in range(2000)]
    for form in ("NFC", "NFD"):
        assert lookalikes.consistent_texts(pa.array(texts)) == lookalikes.consistent_texts(pa.array([unicodedata.normalize(form, t) for t in texts]))


def test_match_names(spark):
    catalog = spark.createDataFrame([(1, "I", "a-b"), (2, "I", "café"), (3, "J", "a-b"), (9, "I", "a–b")], "name_id long, field string, name string")
    rows = [("a-b", 0), ("a–b", 0), ("ａ-b", 1), ("cafe\u0301", 2), ("café ", 0), ("CAFÉ", 0), (None, 0), ("", 0), ("cаfé", 2)]
    values = spark.createDataFrame([("s", i, "I", t) for i, (t, _) in enumerate(rows)], "src string, row_id long, field string, text string").withColumn("name_id", F.lit(7))
    got = {r.row_id: r.name_id for r in lookalikes.match_names(values, catalog).collect()}
    assert got == {i: n for i, (_, n) in enumerate(rows) if n}


# ---- runs ----


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_runs_equal_the_plain_loop(spark, parts):
    rng = random.Random(parts)
    hosts = ["H1.x.y", "h1", "10.0.0.1", "10.0.0.2", "::ffff:10.0.0.1", "-", "", None, "hot", "hot", "hot"]
    rows = [(i, rng.choice(["r1", "r2"]), rng.choice(hosts), rng.choice([" Q1", "q1", "q2 ", None]), T0 + dt.timedelta(seconds=rng.randint(0, 60)), rng.choice([None, T0 + dt.timedelta(seconds=100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "det_id long, rec string, host string, rule string, a timestamp, z timestamp")
    got = runs.collapse(df, [F.col("rec"), runs.host_key(F.col("host"))], runs.same_text(F.col("rule")), "a", "z", "det_id", parts).collect()

    def host(h):
        h = (h or "").lower().removeprefix("::ffff:")
        return None if h in ("", "-") else h if h[0].isdigit() else h.split(".")[0]

    by = collections.defaultdict(list)
    for r in rows:
        if host(r[2]):
            by[r[1], host(r[2])].append(r)
    want = set()
    for own in by.values():
        own.sort(key=lambda r: (r[4], r[0]))
        start = 0
        for i in range(1, len(own) + 1):
            rule = lambda r: r[3] and r[3].strip().lower()
            if i == len(own) or rule(own[i]) != rule(own[start]):
                run = own[start:i]
                want.add((run[0][0], run[-1][0], len(run), run[0][4], max(r[5] or r[4] for r in run)))
                start = i
    assert {(r.first_id, r.last_id, r.n, r.start_ts, r.end_ts) for r in got} == want and len(got) == len(want)


def test_no_runs(spark):
    df = spark.createDataFrame([(1, None, "q", T0, T0)], "det_id long, host string, rule string, a timestamp, z timestamp")
    assert runs.collapse(df, [F.col("host")], F.col("rule"), "a", "z", "det_id").count() == 0


# ---- tokens ----


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(tokens.VOCABULARIES, tokens.NAME)


def reference(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{tokens.VOCABULARIES}/{tokens.NAME}.json")
    own.encode_special_tokens = True
    return [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizer(encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij ABC eeet 0123 '.,-_=\n\tüé中文🎉") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice(["the", "ing", "er", "tion", "AB", "zz", "ata"]) for _ in range(30)) for _ in range(2000)]
    texts += ["", "<|endoftext|> x", "a" * 3000, "=" * 5000, "ab" * 4000, " " * 300, "".join(chr(rng.randint(33, 126)) for _ in range(20_000))]
    ids, edges = encoder(texts)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == reference(texts)


def test_a_pair_is_compatible_exactly_if_bpe_keeps_it(encoder):
    import numpy as np

    rng = np.random.default_rng(1)
    own = encoder.vocabulary
    ids = np.flatnonzero(own.own & np.array([0 < len(t) < 6 for t in own.tokens]))
    a, b = rng.choice(ids, 3000), rng.choice(ids, 3000)
    want = [own.merge_exactly(own.tokens[x] + own.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert own.compatible(a, b).tolist() == want and 0 < sum(want) < 3000


def test_encode_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_documents(df).collect())
    assert got == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])]
    assert tokens.encode_documents(df.limit(0)).count() == 0


# ---- languages ----

TEXTS = {
    "de": "Der schnelle Fuchs springt über den faulen Hund und läuft dann weiter durch den dunklen Wald, weil er nicht gefunden werden will",
    "en": "The quick fox jumps over the lazy dog and then runs on through the dark forest because it does not want to be found by anyone",
    "fr": "Le renard rapide saute par dessus le chien paresseux et court ensuite dans la forêt sombre parce qu'il ne veut pas être trouvé",
    "es": "El zorro veloz salta sobre el perro perezoso y luego corre por el bosque oscuro porque no quiere que nadie lo encuentre nunca",
    "ru": "Быстрая лиса прыгает через ленивую собаку и потом бежит дальше по тёмному лесу, потому что она не хочет быть найденной",
    "zh": "敏捷的狐狸跳过懒狗，然后继续穿过黑暗的森林，因为它不想被任何人发现，也不想回到村庄里去。",
}


def paragraph(rng, lang):
    words = TEXTS[lang] if lang == "zh" else TEXTS[lang].split()
    return ("" if lang == "zh" else " ").join(rng.choice(words) for _ in range(30))


def test_languages_on_held_out_documents(spark):
    rng = random.Random(8)
    rows, truth = [], set()
    for i in range(240):
        lang = rng.choice(list(TEXTS))
        label = rng.choice([lang] * 8 + [lang.upper(), f"{lang}-XX"])
        if rng.random() < 0.15:
            label = rng.choice([None, "", "-", "und", "xx", rng.choice([x for x in TEXTS if x != lang])])
            truth.add((i, -1, -1, lang))
        cells = [("text", [(lang, paragraph(rng, lang)) for _ in range(3)]), ("code", [("", "x = 1")]), ("text", [(lang, paragraph(rng, lang)) for _ in range(2)])]
        if rng.random() < 0.3:
            other = rng.choice([x for x in TEXTS if x != lang and (x == "zh") == (lang == "zh")] or [lang])
            if other != lang:
                cells[2][1].append((other, paragraph(rng, other)))
                truth.add((i, 2, 2, other))
        bodies = ["\n\n".join(t for _, t in ps) for _, ps in cells]
        starts, at = [], 0
        for b in bodies:
            starts.append(at)
            at += len(b) + 2
        rows.append((i, "\n\n".join(bodies), label, [k for k, _ in cells], starts, [len(b) for b in bodies]))
    rows += [(900, None, "en", ["text"], [0], [5]), (901, "", "en", [], [], []), (902, "12 34", None, ["text"], [0], [5]), (903, "code", None, ["code"], [0], [4]), (904, "abc", "en", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, cell_kind array<string>, cell_start array<int>, cell_len array<int>").withColumn("confidence", F.lit(1))
    profiles = languages.train(df, sample=20)
    assert profiles.languages == sorted(TEXTS)
    assigned = languages.assign(df, profiles)
    got = {(r.doc_id, r.cell_no, r.para_no, r.lang) for r in languages.found(assigned).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.03 * len(truth)
    rows = {(r.doc_id, r.cell_no): r for r in assigned.where("doc_id >= 900").collect()}
    assert set(rows) == {(902, -1), (902, 0)} and rows[902, 0].lang is None


def test_labels():
    assert languages.paragraphs("ab\n\ncd", ["text"], [0], [99]) == [(0, 0, "ab"), (0, 1, "cd")]
    assert languages.paragraphs("ab", ["text"], [None], [None]) == []


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "some text", None, ["text"], [0], [9])], "doc_id long, text string, lang string, cell_kind array<string>, cell_start array<int>, cell_len array<int>")
    assert languages.found(languages.assign(df, languages.train(df))).count() == 0


def test_frequent_damage_in_two_cases_is_no_word(spark):
    """A damaged form that comes often, and in small letters too, stays damage; a known word in capitals stays a word."""
    texts = ["größe"] * 1500 + ["über"] * 900 + ["grÃ¶ÃŸe"] * 60 + ["grã¶ãÿe"] * 2 + ["GRÖßE"] * 3 + ["ÜBER"] * 2 + ["копия"] * 700 + ["КОПИЯ"] * 2
    values = spark.createDataFrame([(i, "f", f"a {t}.txt") for i, t in enumerate(texts)], "row_id long, field string, text string")
    bad = {texts[r.rid] for r in mojibake.found(values, mojibake.fit(values)).collect()}
    assert "grÃ¶ÃŸe" in bad and not bad & {"größe", "über", "GRÖßE", "ÜBER", "копия", "КОПИЯ"}
