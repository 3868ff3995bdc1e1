"""Text decoded with a wrong encoding: found and repaired by expectation-maximization over latent encoding chains.

A text's parts between ASCII punctuation (tokens) are damaged apart from one
another, as names are pasted into paths and command lines, so the latent chain
belongs to a token. A chain is the encoding the bytes were written in and the
one they were read with, once or twice. Distinct tokens with their counts are
all the model sees, so its cost follows the vocabulary, not the rows.

A token is either clean, or a chain's damage of what the chain's inverse gives.
The model of clean text has two parts, both learned from the tokens weighted
with their probability to be clean: how often the restored token occurs clean
anywhere (evidence pooled over all records and fields), and, for a token that
occurs nowhere, a model of its characters. Chain priors and the rate of damage
are learned per source and field and drawn to those of all sources, so a token
may be clean in one source and damaged in another.
E-step: posterior of every chain of every token; M-step: clean counts,
character model, chain priors, rate of damage. Then each record is repaired by
the posterior of its tokens.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.session import Tables

# Encodings in which bytes are written, and with which they are read.
WRITTEN = ["utf-8", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "shift_jis", "gbk"]
READ = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman", "gbk", "shift_jis"]
MANY_BYTES = {"utf-8", "shift_jis", "gbk"}
CHAINS = [(w, r) for w in WRITTEN for r in READ if w != r and not (w == "cp1252" and r == "latin-1")]
#: Chains of two steps, of letters made small after the damage, of what was lost in it, and of two-byte text of which some bytes fell on ASCII signs that part tokens.
TWICE, SMALL, LOST, PART = len(CHAINS), len(CHAINS) + 4, len(CHAINS) + 5, len(CHAINS) + 6
NAMES = [f"{w} read as {r}" for w, r in CHAINS] + [f"utf-8 read as {a}, twice" for a in ("cp1252", "latin-1", "cp437", "cp850")] + ["utf-8 read as cp1252, then in small letters", "lost", "two-byte text in parts"]
CLEAN = -1
#: Log-odds against a restored token that occurs nowhere, when its chain could make one of anything.
UNSEEN = -15.0
#: Log-probability of another case of a word that occurs clean, so many times as often at least.
OTHER_CASE, OFTENER = -3.0, 3
#: Rounds end when the share of damaged occurrences changes by less than this part of it, at the latest after so many.
SETTLED, ROUNDS = 0.002, 12
#: Token occurrences that the priors of all sources count for in those of one source.
SHRINK = 50.0
SPLIT = r"[\x00-@\[-`{-\x7f]+"


@functools.lru_cache(None)
def to_byte(read: str) -> dict[str, int]:
    """The byte that a single-byte encoding reads as each character; bytes it leaves open are read as the control of their number."""
    out = {}
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(read), b)
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    return out


def undo(token: str, written: str, read: str) -> str | None:
    """What `written` bytes were, read as `read`, for the whole token."""
    try:
        if read in MANY_BYTES:
            raw = token.encode(read)
        else:
            table = to_byte(read)
            raw = bytes([table[c] for c in token])
        return raw.decode(written)
    except (KeyError, UnicodeError):
        return None


def undo_pieces(token: str, read: str, small: bool = False) -> str | None:
    """UTF-8 sequences among the token's characters, read as `read`, restored; the others stay. small: lead bytes may have been made small letters."""
    table = to_byte(read)
    raw = [table.get(c, -1) if ord(c) > 127 else -1 for c in token]
    out, i, hits = [], 0, 0
    while i < len(token):
        got = None
        leads = [raw[i]]
        if small and (up := table.get(token[i].upper(), -1)) not in (raw[i], -1):
            leads.append(up)
        for lead in leads:
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            rest = raw[i + 1 : i + size]
            if size and len(rest) == size - 1 and all(0x80 <= b <= 0xBF for b in rest):
                try:
                    got = (bytes([lead, *rest]).decode("utf-8"), size)
                    break
                except UnicodeDecodeError:
                    pass
        if got:
            out.append(got[0])
            i += got[1]
            hits += 1
        else:
            out.append(token[i])
            i += 1
    return "".join(out) if hits else None


def undo_part(token: str, read: str) -> str | None:
    """What Shift-JIS bytes were, read as a single-byte encoding, of a token that ends in the middle of a character; three characters at least."""
    table = to_byte(read) if read not in MANY_BYTES else {}
    raw = [table.get(c, 0) for c in token]
    if len(raw) < 7 or len(raw) % 2 == 0 or not all(0x81 <= b <= 0x9F or 0xE0 <= b <= 0xFC for b in raw[::2]):
        return None
    try:
        text = bytes(raw[:-1]).decode("shift_jis")
    except UnicodeError:
        return None
    return text if 2 * len(text) == len(raw) - 1 and all(c.isalpha() for c in text) else None


def shown(text: str) -> bool:
    return all(c != "�" and unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in text)


def candidates(token: str) -> list[tuple[int, str]]:
    """(chain, restored token), the first chain of those that restore alike."""
    out: dict[str, int] = {}

    def offer(chain: int, text: str | None) -> None:
        if text and text != token and shown(text) and any(ord(c) > 127 for c in text):
            out.setdefault(text, chain)

    for chain, (written, read) in enumerate(CHAINS):
        offer(chain, undo(token, written, read))
        if written == "utf-8" and read not in MANY_BYTES:
            once = undo_pieces(token, read)
            offer(chain, once)
    for i, read in enumerate(("cp1252", "latin-1", "cp437", "cp850")):
        once = undo_pieces(token, read)
        twice = undo_pieces(once, read) if once else None
        offer(TWICE + i, twice)
        thrice = undo_pieces(twice, read) if twice else None
        offer(TWICE + i, thrice)
    once = undo_pieces(token, "cp1252", True)
    offer(SMALL, once)
    offer(SMALL, undo_pieces(once, "cp1252", True) if once else None)
    for read in READ:
        if (part := undo_part(token, read)) is not None:
            offer(PART, part)
    found = [(chain, text) for text, chain in out.items()]
    if any(c == "�" or "\x80" <= c <= "\x9f" for c in token):
        found.append((LOST, ""))
    return found


@functools.lru_cache(1 << 16)
def kind(char: str) -> str:
    """A coarse class of a character: script and case of letters, category of others."""
    if char < "\x80":
        return "a" if char.islower() else "A" if char.isupper() else "."
    category = unicodedata.category(char)
    if category[0] == "L" and category != "Lm":
        script = unicodedata.name(char, "?").split(" ")[0]
        return f"{script}-{category}-{ord(char) >> 8 if script == 'LATIN' else ''}"
    return category


@dataclass
class Letters:
    """The character model: classes as a chain, characters inside their class."""

    steps: Counter = field(default_factory=Counter)
    chars: Counter = field(default_factory=Counter)

    def add(self, token: str, weight: float) -> None:
        before = "^"
        for c in token:
            k = kind(c)
            self.steps[before, k] += weight
            self.chars[c] += weight
            before = k
        self.steps[before, "$"] += weight

    def ready(self) -> Letters:
        self.out, self.size, self.inside = Counter(), Counter(), Counter()
        for (a, _), n in self.steps.items():
            self.out[a] += n
        for c, n in self.chars.items():
            self.size[kind(c)] += 1
            self.inside[kind(c)] += n
        return self

    def log(self, token: str) -> float:
        total, before = 0.0, "^"
        for k, c in [*((kind(c), c) for c in token), ("$", None)]:
            total += math.log((self.steps[before, k] + 0.05) / (self.out[before] + 2))
            if c is not None:
                total += math.log((self.chars[c] + 0.1) / (self.inside[k] + 0.1 * (self.size[k] + 40)))
            before = k
        return total


def tokens_of(text: Column) -> Column:
    """The distinct tokens of a text that are not all ASCII."""
    return F.array_distinct(F.filter(F.split(text, SPLIT), lambda t: t.rlike(r"[^\x00-\x7f]")))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, k, r) for t in batch["token"].to_pylist() for k, r in candidates(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["token", "chain", "restored"])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps and characters of a part of the tokens: rows a class pair and a character, not a token."""
    letters = Letters()
    for batch in batches:
        for token, weight in zip(batch["token"].to_pylist(), batch["weight"].to_pylist()):
            if weight > 1e-6:
                letters.add(token, weight)
    rows = [(a, b, n) for (a, b), n in letters.steps.items()] + [(None, c, n) for c, n in letters.chars.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "n"])


def _score(letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters.ready()
        log = functools.lru_cache(1 << 16)(letters.log)
        for batch in batches:
            scores = []
            for token, n, chain, restored, w, prior, rate in zip(*(batch[c].to_pylist() for c in ("token", "everywhere", "chain", "restored", "w", "prior", "rate"))):
                prior = math.log(prior)
                if chain == CLEAN:
                    scores.append(prior + max(log(token), OTHER_CASE if w and w > max(0.5, OFTENER * n) else -math.inf))
                elif chain == LOST:
                    scores.append(prior - 2.0 * len(token))
                else:
                    strict = chain != PART and (chain >= TWICE or CHAINS[chain][0] == "utf-8")
                    unseen = log(restored) + (0.0 if strict else UNSEEN)
                    seen = -n * max(0.0, math.log(n / (rate * w))) - 2.0 if w and w > 0.5 else -math.inf
                    scores.append(prior + max(unseen, seen))
            kept = ["source", "field", "token", "n", "everywhere", "chain", "restored"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(scores, pa.float64())], [*kept, "score"])

    return run


def sourced(values: DataFrame) -> DataFrame:
    """values with source; a null one, or none at all, is the source ""."""
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in values.columns else F.lit("")
    return values.withColumn("source", source)


def fit(values: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """source, field, token, n, everywhere, clean, chain, restored: the posterior of every distinct token of a source.

    values: row_id, field, text and, where it is known, source. n counts the
    token in its source, everywhere in the field. clean is the probability that
    the token is as written; chain and restored are those of the likeliest
    damage (restored is null where the original is lost). Null and ASCII texts
    have no tokens.
    """
    spark = values.sparkSession
    tables = Tables(spark, "mojibake")
    key = ["source", "field", "token"]
    counts = sourced(values).where(F.col("text").rlike(r"[^\x00-\x7f]")).select("source", "field", F.explode(tokens_of(F.col("text"))).alias("token")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    counts = tables.put(counts)
    everywhere = counts.groupBy("field", "token").agg(F.sum("n").alias("everywhere"))
    state = tables.put(counts.join(everywhere, ["field", "token"]).select(*key, "n", "everywhere", F.lit(1.0).alias("clean"), F.lit(CLEAN).alias("chain"), F.lit(None).cast("string").alias("restored")))
    tables.drop(counts)
    offers = tables.put(state.select("token").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(_candidates, "token string, chain int, restored string"))
    fields = [r[0] for r in state.select("field").distinct().collect()]
    start = {f: {CLEAN: 0.9, **dict.fromkeys(range(PART + 1), 0.1 / (PART + 1))} for f in fields}
    priors = {(f, k): p for f, own in start.items() for k, p in own.items()}
    rate = 0.05
    of_source = None  # source, field, whole, hurt, own_rate, mass by chain
    before = 0.0
    for _ in range(rounds):
        letters = Letters()
        for r in state.select("token", (F.col("n") * F.col("clean")).alias("weight")).mapInArrow(_stats, "a string, b string, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            if r.a is None:
                letters.chars[r.b] = r.n
            else:
                letters.steps[r.a, r.b] = r.n
        weight = state.groupBy(F.col("token").alias("_r")).agg(F.sum(F.col("n") * F.col("clean")).alias("w"))
        own = state.select(*key, "n", "everywhere")
        damaged = own.join(offers, "token").join(weight, F.col("restored") == F.col("_r"), "left").select(*key, "n", "everywhere", "chain", "restored", "w")
        # clean occurrences of the same word in another case
        cases = state.groupBy(F.lower("token").alias("_low")).agg(F.sum(F.col("n") * F.col("clean")).alias("_all"))
        mine = own.join(weight, F.col("token") == F.col("_r")).join(cases, F.lower("token") == F.col("_low"))
        mine = mine.select(*key, "n", "everywhere", F.lit(CLEAN).alias("chain"), F.lit(None).cast("string").alias("restored"), (F.col("_all") - F.col("w")).alias("w"))
        every = damaged.unionByName(mine)
        pooled = F.broadcast(spark.createDataFrame([(f, k, p, 1 - priors[f, CLEAN]) for (f, k), p in priors.items()], "field string, chain int, pooled double, any double"))
        every = every.join(pooled, ["field", "chain"])
        if of_source is None:
            every = every.withColumns({"prior": F.col("pooled"), "rate": F.lit(rate)})
        else:
            # the share of damage in the source, and of the chain in its damage: many chains are too rare in a source for shares of all
            hurt = (F.col("hurt") + SHRINK * F.col("any")) / (F.col("whole") + SHRINK)
            of_hurt = (F.coalesce(F.col("mass")[F.col("chain")], F.lit(0.0)) + SHRINK * F.col("pooled") / F.col("any")) / (F.col("hurt") + SHRINK)
            share = F.when(F.col("chain") == CLEAN, 1 - hurt).otherwise(hurt * of_hurt)
            every = every.join(of_source, ["source", "field"]).withColumns({"prior": share, "rate": F.col("own_rate")})
        every = every.select(*key, "n", "everywhere", "chain", "restored", "w", "prior", "rate")
        scored = every.mapInArrow(_score(letters), "source string, field string, token string, n long, everywhere long, chain int, restored string, score double")
        # a token has at most one row a chain
        grouped = scored.groupBy(*key, "n", "everywhere").agg(F.collect_list(F.struct("score", "chain", "restored")).alias("all"))
        top = F.array_max(F.transform("all", lambda x: x["score"]))
        parts = F.transform("all", lambda x: F.struct(F.exp(x["score"] - F.col("top")).alias("p"), x["chain"].alias("chain"), x["restored"].alias("restored")))
        total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["p"])
        clean = F.aggregate(F.filter("parts", lambda x: x["chain"] == CLEAN), F.lit(0.0), lambda s, x: s + x["p"])
        best = F.array_max(F.filter("parts", lambda x: x["chain"] != CLEAN))
        after = grouped.withColumn("top", top).withColumn("parts", parts).select(*key, "n", "everywhere", (clean / total).alias("clean"), F.coalesce(best["chain"], F.lit(CLEAN)).alias("chain"), F.when(best["chain"] != PART, F.nullif(best["restored"], F.lit(""))).alias("restored"))
        old, state = state, tables.put(after)
        tables.drop(old)
        mass: Counter = Counter()
        for r in state.groupBy("field", "chain").agg(F.sum(F.col("n") * F.col("clean")).alias("c"), F.sum(F.col("n") * (1 - F.col("clean"))).alias("d")).collect():
            mass[r.field, CLEAN] += r.c
            mass[r.field, r.chain] += r.d
        for f in fields:
            whole = sum(mass[f, k] for k in range(-1, PART + 1)) + 0.02 * (PART + 2)
            for k in range(-1, PART + 1):
                priors[f, k] = (mass[f, k] + 0.02) / whole
        damage, intact = (sum(v for (_, k), v in mass.items() if (k == CLEAN) == c) for c in (False, True))
        rate = min(0.3, max(0.05, 2 * damage / max(intact, 1.0)))
        # the same of each source, drawn to that of all; a row a source and field, which stays in a table
        share = damage / max(damage + intact, 1.0)
        if abs(share - before) <= SETTLED * share:
            break
        before = share
        by_chain = state.select("source", "field", F.inline(F.array(F.struct(F.lit(CLEAN).alias("k"), (F.col("n") * F.col("clean")).alias("m")), F.struct(F.col("chain").alias("k"), (F.col("n") * (1 - F.col("clean"))).alias("m")))))
        by_chain = by_chain.groupBy("source", "field", "k").agg(F.sum("m").alias("m"))
        bad, good = F.sum(F.when(F.col("k") != CLEAN, F.col("m")).otherwise(0.0)) + SHRINK * share, F.sum(F.when(F.col("k") == CLEAN, F.col("m")).otherwise(0.0)) + SHRINK * (1 - share)
        own_rate = F.least(F.lit(0.3), F.greatest(F.lit(0.05), 2 * bad / F.greatest(good, F.lit(1.0))))
        old = of_source
        of_source = tables.put(by_chain.groupBy("source", "field").agg(F.sum("m").alias("whole"), F.sum(F.when(F.col("k") != CLEAN, F.col("m")).otherwise(0.0)).alias("hurt"), own_rate.alias("own_rate"), F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("mass")))
        tables.drop(old)
    return state


def damaged_tokens(values: DataFrame, state: DataFrame) -> DataFrame:
    """row_id, field, text, token, chain, restored: the damaged tokens of each value."""
    bad = state.where("clean < 0.5").select(F.col("source").alias("_source"), F.col("field").alias("_field"), F.col("token").alias("_token"), "chain", "restored")
    rows = sourced(values).where(F.col("text").rlike(r"[^\x00-\x7f]")).select("row_id", "source", "field", "text", F.explode(tokens_of(F.col("text"))).alias("token"))
    return rows.join(bad, (F.col("source") == F.col("_source")) & (F.col("field") == F.col("_field")) & (F.col("token") == F.col("_token"))).drop("source", "_source", "_field", "_token")


def found(values: DataFrame, state: DataFrame) -> DataFrame:
    return damaged_tokens(values, state).select(F.col("row_id").alias("rid"), "field").distinct()


def repair(values: DataFrame, state: DataFrame) -> DataFrame:
    """row_id, field, text, repaired, chains, whole of each damaged value; whole: nothing of it is lost."""
    per = damaged_tokens(values, state).groupBy("row_id", "field").agg(
        F.first("text").alias("text"), F.map_from_entries(F.collect_set(F.when(F.col("restored").isNotNull(), F.struct("token", "restored")))).alias("by"),
        F.array_join(F.sort_array(F.collect_set(F.element_at(F.array(*map(F.lit, NAMES)), F.col("chain") + 1))), "; ").alias("chains"), F.count(F.when(F.col("restored").isNull(), 1)).alias("lost"))
    # token by token: a damaged token may also be a part of another one
    tokens = F.transform(F.split("text", SPLIT), lambda t: F.coalesce(F.col("by")[t], t))
    between = F.array_append(F.regexp_extract_all("text", F.lit(f"({SPLIT})"), 1), F.lit(""))
    text = F.array_join(F.zip_with(tokens, between, lambda t, b: F.concat(t, b)), "")
    return per.select("row_id", "field", "text", text.alias("repaired"), "chains", (F.col("lost") == 0).alias("whole"))
