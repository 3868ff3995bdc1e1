"""Rules as Spark predicates: every leaf is one built-in expression, null-safe and two-valued."""

from __future__ import annotations

import functools
import ipaddress
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanternlog.plans.rulebook import CLOUD_PRODUCTS, SERVICE_CHANNELS, Rule, fold

any_of = functools.partial(functools.reduce, operator.or_)
all_of = functools.partial(functools.reduce, operator.and_)
#: From so many values on, equality is one set lookup and substrings one alternation.
MANY = 16


class Event:
    """Access to the fields of an event row, by names without regard to case: promoted columns, else the `fields` map. Folded columns are projected once."""

    def __init__(self, columns: list[str], spark: SparkSession | None = None, folded: dict[str, str] | None = None):
        self.columns, self.spark, self.folded = set(columns), spark, folded or {}
        self.by_low = {c.lower(): c for c in columns if c != "fields"}
        #: Columns made once for all rules that read them; making one costs more than holding it.
        self.texts: dict[str, Column] = {}
        self.lowered: dict[str, Column] = {}
        self.gates: dict[tuple, Column] = {}

    def text(self, name: str) -> Column:
        if name not in self.texts:
            self.texts[name] = self._text(name)
        return self.texts[name]

    def _text(self, name: str) -> Column:
        if name.lower() in self.by_low:
            return F.col(f"`{self.by_low[name.lower()]}`").cast("string")
        if "fields" not in self.columns:
            return F.lit(None).cast("string")
        return (F.col("_fields") if "_fields" in self.columns else small_names(F.col("fields")))[name.lower()]

    def lower(self, name: str) -> Column:
        if name not in self.lowered:
            self.lowered[name] = F.col(self.folded[name]) if name in self.folded else F.lower(self.text(name))
        return self.lowered[name]

    def blob(self) -> Column:
        """All values in one lower-case text: columns in name order, then the map's values by key."""
        if "_blob" in self.columns:
            return F.col("_blob")
        plain = [F.col(f"`{c}`").cast("string") for c in sorted(self.columns - {"fields"}) if c[:1] != "_" or c == "_platform"]
        rest = [F.array_join(F.transform(F.sort_array(F.map_entries("fields")), lambda e: e["value"]), " ")] if "fields" in self.columns else []
        return F.lower(F.concat_ws(" ", *plain, *rest))


def small_names(fields: Column) -> Column:
    """A map with small-letter names, as the lake has it already; of names that differ in case only the first counts."""
    low = F.transform(F.map_keys(fields), lambda k: F.lower(k))
    once = F.filter(F.map_entries(fields), lambda e, i: F.array_position(low, F.lower(e["key"])) == i + 1)
    return F.when(F.forall(F.map_keys(fields), lambda k: k == F.lower(k)), fields).otherwise(F.map_from_entries(F.transform(once, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))


def glob_regex(pattern: str) -> str:
    """A whole-text glob as a regular expression: `*`, `?`, and classes; `[!` negates."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(column: Column, pattern: str) -> Column:
    if "[" in pattern:
        return column.rlike(glob_regex(pattern))
    like = re.sub(r"([%_!])", r"!\1", pattern).replace("*", "%").replace("?", "_")
    return F.like(column, F.lit(like), F.lit("!"))


def java_regex(spark: SparkSession, pattern: str) -> str | None:
    """The pattern in the JVM's dialect, None if the JVM can't take it."""
    pattern = re.sub(r"\(\?P<", "(?<", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - py4j wraps PatternSyntaxException
        return None
    return pattern


def regex(column: Column, pattern: str, spark: SparkSession) -> Column:
    if (own := java_regex(spark, pattern)) is not None:
        return column.rlike(own)

    @F.pandas_udf("boolean")
    def find(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return values.map(lambda v: v is not None and compiled.search(v) is not None)

    return find(column)


def ipv4_number(column: Column) -> Column:
    """An IPv4 text as a number; null for anything else."""
    part = r"(0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
    octets = F.split(column, r"\.")
    value = sum((F.element_at(octets, i + 1).try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(column.rlike(rf"^{part}(\.{part}){{3}}$"), value)


def cidr(column: Column, network: str) -> Column:
    """Membership; mapped and bracketed addresses are reduced, non-addresses are in no network, a bad network holds none."""
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    bare = F.regexp_replace(F.regexp_replace(column, r"^\[+|\]+$", ""), "^::ffff:", "")
    if net.version == 4:
        return ipv4_number(bare).between(int(net[0]), int(net[-1]))

    @F.pandas_udf("boolean")
    def inside(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> bool:
            try:
                return v is not None and ipaddress.ip_address(v) in net
            except ValueError:
                return False

        return values.map(one)

    return F.when(bare.contains(":"), inside(bare)).otherwise(False)


def leaf(event: Event, name: str, value: object, modifiers: list[str]) -> Column:
    """One field against one value; null where the field is."""
    if value is None:
        text = event.text(name)
        return text.isNull() | text.isin("", "-")
    text = str(value)
    if "re" in modifiers:
        hit = regex(event.text(name), text, event.spark)
    elif "cidr" in modifiers:
        hit = cidr(event.text(name), text)
    elif "windash" in modifiers:
        rest = [m for m in modifiers if m != "windash"]
        return any_of([leaf(event, name, v, rest) for v in dict.fromkeys([text, text.replace("-", "/"), text.replace("/", "-")])])
    else:
        column, low = event.lower(name), text.lower()
        if "contains" in modifiers:
            hit = column.contains(low)
        elif "startswith" in modifiers:
            hit = column.startswith(low)
        elif "endswith" in modifiers:
            hit = column.endswith(low)
        elif "*" in text or "?" in text:
            hit = glob(column, low)
        else:
            hit = column == low
    return hit


def _field(event: Event, key: str, expected: object) -> Column:
    name, *modifiers = key.split("|")
    values = expected if isinstance(expected, list) else [expected]
    if not values:
        return F.lit("all" in modifiers)
    plain = not set(modifiers) & {"re", "cidr", "windash", "all"} and all(v is not None for v in values)
    if plain and len(values) >= MANY:
        low = [str(v).lower() for v in values]
        if not modifiers and not any("*" in v or "?" in v for v in low):
            return F.coalesce(event.lower(name).isin(low), F.lit(False))
        if modifiers:
            quoted = "|".join(re.escape(v) for v in low)
            shape = {"contains": "(?s){}", "startswith": "(?s)^(?:{})", "endswith": "(?s)(?:{})$(?!\n)"}[modifiers[0]]
            if modifiers[0] != "endswith":
                return F.coalesce(event.lower(name).rlike(shape.format(quoted)), F.lit(False))
    # a null leaf counts as false; within and, or it may as well at the end
    hits = [leaf(event, name, v, modifiers) for v in values]
    return F.coalesce(all_of(hits) if "all" in modifiers else any_of(hits), F.lit(False))


def _map(event: Event, selection: dict) -> Column:
    return all_of([_field(event, k, v) for k, v in selection.items()]) if selection else F.lit(True)


def selection(event: Event, given: object) -> Column:
    """A map is AND over its fields; a list of maps OR; a list of scalars a keyword search."""
    if isinstance(given, list):
        if given and all(isinstance(g, (str, int)) for g in given):
            words = [str(g).lower().strip("*") for g in given]
            hit = event.blob().rlike("(?s)" + "|".join(map(re.escape, words))) if len(words) >= MANY else any_of([event.blob().contains(w) for w in words])
            return F.coalesce(hit, F.lit(False))
        maps = [_map(event, g) for g in given if isinstance(g, dict)]
        return any_of(maps) if maps else F.lit(False)
    return _map(event, given if isinstance(given, dict) else {})


def condition(event: Event, rule: Rule) -> Column:
    own = {k: selection(event, v) for k, v in rule.selections.items()}
    of = lambda every, parts: (all_of(parts) if every else any_of(parts)) if parts else F.lit(every)  # noqa: E731 - all of none is true
    return fold(rule.condition, own, own.__getitem__, operator.inv, of, of)


def squash(column: Column) -> Column:
    return F.translate(F.lower(column), "- /", "")


def source_gate(event: Event, rule: Rule) -> Column:
    """Platform, Sysmon-number and channel gates of a rule's log source."""
    key = tuple(sorted(rule.logsource.items()))
    if key not in event.gates:
        event.gates[key] = _source_gate(event, rule)
    return event.gates[key]


def _source_gate(event: Event, rule: Rule) -> Column:
    gates = []
    product, service = rule.logsource.get("product", ""), rule.logsource.get("service", "")
    platform = event.text("_platform")
    if product in CLOUD_PRODUCTS:
        if product == "m365":
            gates.append(F.coalesce(platform.isin("m365", "m365d"), F.lit(False)))
        else:
            gates.append(platform.isNull() | (platform == product))
    elif product:
        gates.append(platform.isNull() | (platform == "") | (platform == product))
    channel = F.coalesce(F.lower(event.text("Channel")), F.lit(""))
    if rule.logsource.get("category"):
        number = F.col("EventID")
        reused = (number <= 29) | (number == 255)
        gates.append(~(F.coalesce(reused, F.lit(False)) & (channel != "") & ~channel.contains("sysmon")))
    if service:
        known = SERVICE_CHANNELS.get(service)
        inside = channel.isin(known) if known else squash(channel).contains(re.sub("[- /]", "", service))
        gates.append((channel == "") | inside)
    return all_of(gates) if gates else F.lit(True)


def compile_rule(rule: Rule, event: Event) -> Column:
    """The whole rule as one boolean column."""
    parts = [source_gate(event, rule)]
    if rule.category_events and not rule.pins_event_id:
        parts.append(F.coalesce(F.col("EventID").isin(rule.category_events), F.lit(False)))
    return all_of([*parts, condition(event, rule)])


def fold_columns(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Event]:
    """df with the fields that the rules compare folded to lower case once, and the access to them."""
    if "fields" in df.columns:
        df = df.withColumn("_fields", small_names(F.col("fields")))
    names = sorted({k.split("|")[0] for r in rules for s in r.selections.values() for m in (s if isinstance(s, list) else [s]) if isinstance(m, dict) for k in m})
    plain = Event(df.columns, df.sparkSession)
    folded = {n: f"_low_{i}" for i, n in enumerate(names)}
    added = {c: F.lower(plain.text(n)) for n, c in folded.items()}
    if any(isinstance(s, list) and s and all(isinstance(x, (str, int)) for x in s) for r in rules for s in r.selections.values()):
        added["_blob"] = plain.blob()
    return df.withColumns(added) if added else df, Event([*df.columns, *(["_blob"] if "_blob" in added else [])], df.sparkSession, folded)
