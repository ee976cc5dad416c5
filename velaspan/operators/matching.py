"""Regular-expression detection with exact offsets, and greedy conflict resolution, as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The detection types of the format, and the seven of the older masking format.
TYPES = ("PERSON", "ORGANIZATION", "LOCATION", "ADDRESS", "EMAIL", "PHONE", "COD_UTENTE", "PASSWORD", "NUM_PRATICA", "CODICE_FISCALE", "PARTITA_IVA", "COD_INDAGINE", "INDAGINE", "DATE", "ROLE", "OFFICE")
MASKING_TYPES = ("PERSON", "EMAIL", "PHONE", "ADDRESS", "COD_UTENTE", "PASSWORD", "NUM_PRATICA")


def required(pattern: str, fold: bool) -> str:
    """The longest string that every match of a pattern holds ('' if none is sure); with ``fold`` of characters without case only."""
    runs = [""]

    def walk(tokens) -> None:
        for op, value in tokens:
            if op is parser.LITERAL:
                c = chr(value)
                if fold and c.lower() != c.upper():
                    runs.append("")
                else:
                    runs[-1] += c
            elif op is parser.SUBPATTERN:
                walk(value[3])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
                runs.append("")
                if value[0] > 0:
                    walk(value[2])
                    runs.append("")
            elif op is not parser.AT:
                runs.append("")

    walk(parser.parse(pattern))
    return max(runs, key=len)


@dataclass(frozen=True)
class Rule:
    """A pattern whose group ``valore`` (or group 1) is the detected value."""

    name: str
    type: str
    priority: int
    pattern: str
    flags: str = "iU"

    @property
    def group(self) -> int:
        return re.compile(self.pattern, re.IGNORECASE).groupindex.get("valore", 1)

    @property
    def java(self) -> str:
        return (f"(?{self.flags})" if self.flags else "") + self.pattern.replace("(?P<", "(?<")

    @property
    def needs(self) -> str:
        """A string without which a text has no match."""
        return required(self.pattern, "i" in self.flags)

    @property
    def native(self) -> bool:
        """Whether nothing but assertions follows the value group, so that it ends the match."""
        if "(?P=" in self.pattern:
            return False
        at = self._at
        depth, i, inside = 0, at, False
        while i < len(self.pattern):
            c = self.pattern[i]
            if c == "\\":
                i += 2
                continue
            if c == "[" and not inside:
                inside = True
            elif c == "]" and inside:
                inside = False
            elif not inside:
                depth += (c == "(") - (c == ")")
                if c == ")" and depth == 0:
                    break
            i += 1
        rest = self.pattern[i + 1 :]
        return bool(re.fullmatch(r"(\\b|\$|\(\?[!=](?:[^()\\]|\\.)*\))*", rest))

    @property
    def _at(self) -> int:
        at = self.pattern.find("(?P<valore>")
        return self.pattern.find("(") if at < 0 else at

    @property
    def whole(self) -> bool:
        """Whether the value is all of the match: a native rule with nothing but assertions before its group."""
        before = self.pattern[: self._at]
        return self.native and bool(re.fullmatch(r"(\\b|\^|\(\?<[!=](?:[^()\\]|\\.)*\))*", before))


#: Where a package's own configurations lie.
CONFIGS = Path(__file__).resolve().parent.parent / "configs"


def rules_from(config: dict) -> list[Rule]:
    """Checked rules of a configuration with ``regole``: unique names, known types, whole priorities, a value group."""
    out: list[Rule] = []
    for r in config["regole"]:
        if r["nome"] in {x.name for x in out} or r["tipo"] not in TYPES or type(r["priorita"]) is not int:
            raise ValueError(f"rule {r['nome']!r} is repeated or malformed")
        if "valore" not in re.compile(r["pattern"], re.IGNORECASE).groupindex:
            raise ValueError(f"rule {r['nome']!r} has no group 'valore'")
        out.append(Rule(r["nome"], r["tipo"], r["priorita"], r["pattern"]))
    return out


def read_rules(path: str | Path = CONFIGS / "rules.json") -> list[Rule]:
    """Rules of a configuration file, by default those that come with the package."""
    return rules_from(json.loads(Path(path).read_text(encoding="utf-8")))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Numbers that are summed in one fold: Spark copies a fold's value at every step.
SUMMED = 64


def _running(numbers: str) -> str:
    """SQL of the running sums of an array of int: within blocks, then over blocks."""
    none, one = "cast(array() AS array<int>)", "if(size(acc) = 0, {x}, element_at(acc, -1) + {x})"
    return (
        f"transform(transform(transform(array({numbers}),"
        f" l -> transform(sequence(0, int((size(l) - 1) div {SUMMED})), b -> aggregate(slice(l, b * {SUMMED} + 1, {SUMMED}), {none}, (acc, n) -> array_append(acc, {one.format(x='n')})))),"
        f" r -> named_struct('r', r, 'sums', aggregate(r, {none}, (acc, y) -> array_append(acc, {one.format(x='element_at(y, -1)')})))),"
        " v -> flatten(transform(v.r, (y, b) -> transform(y, n -> n + if(b = 0, 0, v.sums[b - 1])))))[0]"
    )


def matches(text: str, rule: Rule) -> Column:
    """All matches of a rule in the column named ``text``: array of (start, end, type, value, rule, priority).

    The lengths of the pieces between matches and of the matches give the end
    of each match, which is the end of its value. A text without the string
    that the rule needs is not searched, and one without a match only once.
    """
    p = _quoted(rule.java)
    values = f"regexp_extract_all({text}, {p}, 0)" if rule.whole else f"regexp_extract_all({text}, {p}, {rule.group})"
    sure = f"contains({text}, {_quoted(rule.needs)}) AND " if rule.needs else ""
    empty = "cast(array() AS array<struct<start:int,end:int,type:string,value:string,rule:string,priority:int>>)"
    item = (
        "named_struct('start', e.ends[i] - length(x.`1`), 'end', e.ends[i],"
        f" 'type', {_quoted(rule.type)}, 'value', x.`1`, 'rule', {_quoted(rule.name)}, 'priority', {rule.priority})"
    )
    fold = (
        f"transform(transform(array(arrays_zip(regexp_extract_all({text}, {p}, 0), {values}, split({text}, {p}, -1))),"
        f" z -> named_struct('z', z, 'ends', {_running('transform(z, x -> length(x.`2`) + coalesce(length(x.`0`), 0))')})),"
        f" e -> filter(transform(e.z, (x, i) -> if(x.`0` IS NULL, null, {item})), s -> s IS NOT NULL))[0]"
    )
    return F.expr(f"if({sure}{text} rlike {p}, {fold}, {empty})")


def _python_matches(rules: list[Rule]):
    compiled = [(r, re.compile(r.pattern, re.IGNORECASE)) for r in rules]

    @F.pandas_udf("array<struct<start:int,end:int,type:string,value:string,rule:string,priority:int>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"start": m.span(r.group)[0], "end": m.span(r.group)[1], "type": r.type, "value": m.group(r.group), "rule": r.name, "priority": r.priority} for r, p in compiled for m in p.finditer(t or "")])

    return run


def candidates(df: DataFrame, rules: list[Rule], text: str = "text", out: str = "found") -> DataFrame:
    """``df`` with the matches of all rules. Rules whose value does not end the match go through Arrow; the others stay in the JVM."""
    plain = [r for r in rules if r.native]
    other = [r for r in rules if not r.native]
    parts = [matches(text, r) for r in plain] + ([_python_matches(other)(F.col(text))] if other else [])
    return df.withColumn(out, F.flatten(F.array(*parts)))


def detected(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """One row for each match of each rule: columns of ``df`` but the text, then start, end, type, value, rule, priority."""
    return _rows(candidates(df, rules, text), [c for c in df.columns if c != text])


def _rows(found: DataFrame, rest: list[str]) -> DataFrame:
    # not explode(): Spark would filter by the array first, and so compute all of it again below the scan's filter
    return found.select(*rest, F.explode_outer("found").alias("m")).where("m is not null").select(*rest, "m.*")


def greedy(spans: Column, key) -> Column:
    """Spans in the order of ``key`` (a function of a span), each kept unless it overlaps one kept before; by start."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(key(s).alias("key"), s.alias("span"))))
    fold = lambda o: F.aggregate(
        o,
        F.transform(F.slice(o, 1, 0), lambda x: x["span"]),
        lambda acc, x: F.when(F.exists(acc, lambda k: (k["start"] < x["span"]["end"]) & (k["end"] > x["span"]["start"])), acc).otherwise(F.array_append(acc, x["span"])),
    )
    return F.array_sort(F.get(F.transform(F.array(ordered), fold), F.lit(0)))  # the spans are computed once, as the fold's variable


def by_priority(s: Column) -> Column:
    """Higher priority, then longer, then earlier, then the rule's name."""
    return F.struct(-s["priority"], s["start"] - s["end"], s["start"], s["rule"])


def by_score(s: Column) -> Column:
    """Higher score, then longer, then earlier, then type, then the order of arrival."""
    return F.struct(-s["score"], s["start"] - s["end"], s["start"], s["type"], s["ord"])


def resolved(df: DataFrame, rules: list[Rule], text: str = "text", types: tuple[str, ...] | None = None) -> DataFrame:
    """Non-overlapping matches, one row each: the flat view of a text. ``types`` keeps only those."""
    rest = [c for c in df.columns if c != text]
    out = _rows(candidates(df, rules, text).withColumn("found", greedy(F.col("found"), by_priority)), rest)
    return out.where(F.col("type").isin(*types)) if types else out
