"""Rewrite rules: ordered ``pattern => rewrite`` lines applied at token edges.

Rules without regular-expression marks and blanks are literal tokens; they can
run as one look-up a token (``rewrite_tokens``).  The whole engine (``RuleSet``)
applies every kind in file order within one Arrow function; for each text only
the rules whose first token occurs in it are tried.
"""

from __future__ import annotations

import dataclasses
import heapq
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import text_function
from textloom.functions.patterns import BEGIN, END, compiled, pieces, sub
from textloom.session import checkpointed

_MARKS = re.compile(r"[\\^$.|?*+()\[\]{}]")
_POSIX = {"[[:alpha:]]": r"[^\W\d_]", "[[:alnum:]]": r"[^\W_]", "[[:digit:]]": r"\d", "[[:space:]]": r"\s"}
_CLITIC = re.compile(r"'[sS]?$")


@dataclasses.dataclass(frozen=True)
class Rule:
    place: int
    pattern: str
    rewrite: str

    @property
    def literal(self) -> bool:
        return not _MARKS.search(self.pattern)

    @property
    def kind(self) -> str:
        return "regex" if not self.literal else "phrase" if " " in self.pattern else "token"


def translate(pattern: str) -> str:
    """A Perl pattern in Python's dialect: POSIX classes, look-behinds of mixed length split up, and what
    stands before ``\\K``, which stays, in the group ``kept``."""
    for perl, ours in _POSIX.items():
        pattern = pattern.replace(perl, ours)

    def behind(m: re.Match) -> str:
        kind, options = m[1], m[2].split("|")
        if kind == "=":
            return "(?:" + "|".join(f"(?<={o})" for o in options) + ")"
        return "".join(f"(?<!{o})" for o in options)

    pattern = re.sub(r"\(\?<([=!])([^()]*\|[^()]*)\)", behind, pattern)
    kept, mark, rest = pattern.partition(r"\K")
    if mark and re.search(r"\\[1-9]|\\K", kept + rest):
        raise re.error("\\K beside a back-reference or another \\K")
    return f"(?P<kept>{kept}){rest}" if mark else pattern


def parse(lines: Iterable[str], prepare: Callable[[str], str] | None = None, any_case: bool = False) -> list[Rule]:
    """Rules of a file: comments, empty sides and no-ops are skipped, the first of equal patterns wins.

    A pattern that can't be translated is an error that names its line.
    """
    seen: dict[str, str] = {}
    for number, line in enumerate(lines, 1):
        line = (prepare(line) if prepare else line).rstrip("\r\n")
        if not line or line.lstrip(" ").startswith("#"):
            continue
        m = re.match(r"(.*?) => (.*?)(?:\r|#|$)", re.sub(r"\s+", " ", line, count=1))
        if not m or not m[1].strip() or not m[2].strip() or m[1] == m[2]:
            continue
        forms = [(m[1], m[2])]
        if any_case:
            forms += [(m[1][:1].upper() + m[1][1:], m[2][:1].upper() + m[2][1:]), (m[1].upper(), m[2].upper())]
        for pattern, rewrite in forms:
            if pattern not in seen and _MARKS.search(pattern):
                try:
                    re.compile(translate(pattern))
                except re.error as error:
                    raise ValueError(f"rule in line {number}, {pattern}: {error}") from error
            seen.setdefault(pattern, rewrite)
    return [Rule(k, p, r) for k, (p, r) in enumerate(seen.items())]


class RuleSet:
    """Rules in order, indexed by the first token of those that are literal."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.patterns: dict[int, str] = {}
        for k, rule in enumerate(rules):
            if rule.literal:
                self.by_token.setdefault(rule.pattern.split(" ")[0], []).append(k)
            else:
                self.always.append(k)

    def _pattern(self, k: int) -> str:
        if k not in self.patterns:
            rule = self.rules[k]
            body = re.escape(rule.pattern) if rule.literal else translate(rule.pattern)
            self.patterns[k] = f"{BEGIN}(?:{body}){END}"
        return self.patterns[k]

    def _found(self, text: str) -> set[int]:
        if not self.by_token:
            return set()
        tokens = pieces(text)
        found = tokens & self.by_token.keys()
        if "'" in text:
            found |= {_CLITIC.sub("", t) for t in tokens if "'" in t} & self.by_token.keys()
        return {k for token in found for k in self.by_token[token]}

    def apply(self, text: str) -> str:
        if not self.rules:
            return text
        queue = [*self.always, *self._found(text)]
        heapq.heapify(queue)
        tried: set[int] = set()
        while queue:
            k = heapq.heappop(queue)
            if k in tried:
                continue
            tried.add(k)
            rewrite = self.rules[k].rewrite
            after = sub(self._pattern(k), lambda m, r=rewrite: (m.groupdict().get("kept") or "") + r, text)
            if after != text:
                text = after
                for new in self._found(text) - tried:
                    if new > k:
                        heapq.heappush(queue, new)
        return text

    def apply_whole(self, text: str) -> str:
        """Rules in order, each on the whole text or not at all."""
        for k, rule in enumerate(self.rules):
            if rule.literal:
                text = rule.rewrite if text == rule.pattern else text
            elif m := compiled(translate(rule.pattern)).fullmatch(text):
                text = (m.groupdict().get("kept") or "") + rule.rewrite
        return text


class RuleBook:
    """Rule sets by name: loading adds to a set behind its rules, and a set can be reset."""

    def __init__(self):
        self.sets: dict[str, RuleSet] = {}

    def load(self, name: str, lines: Iterable[str], **options) -> RuleSet:
        have = self.sets[name].rules if name in self.sets else []
        known = {r.pattern for r in have}
        new = [r for r in parse(lines, **options) if r.pattern not in known]
        self.sets[name] = RuleSet([*have, *(dataclasses.replace(r, place=len(have) + k) for k, r in enumerate(new))])
        return self.sets[name]

    def reset(self, *names: str) -> None:
        """Empty the named sets, or all."""
        for name in names or list(self.sets):
            self.sets.pop(name, None)

    def apply(self, text: str, *names: str) -> str:
        """The text under the named sets in order; a name without rules changes nothing."""
        for name in names:
            text = self.sets[name].apply(text) if name in self.sets else text
        return text


def apply_rules(df: DataFrame, column: str, *sets: RuleSet) -> DataFrame:
    """The column rewritten by each rule set in turn."""

    def run(text: str) -> str:
        for s in sets:
            text = s.apply(text)
        return text

    return df.withColumn(column, text_function(run)(F.col(column)))


def rules_frame(spark, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.place, r.pattern, r.rewrite, r.kind) for r in rules], "place int, pattern string, rewrite string, kind string")


#: Literal rules are broadcast up to this many bytes of patterns and rewrites.
BROADCAST_BYTES = 32 << 20
_BARE = re.compile("^(.*?)('[sS]?)$", re.S)


def rewrite_tokens(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """The column rewritten by literal one-token rules, one look-up a token.

    Rules of up to BROADCAST_BYTES are a broadcast dictionary in one Arrow function: no
    row is shuffled, and a text is never taken apart into rows.  Beyond, numbered rows
    are written, their distinct tokens meet the rules by a join, and tokens with a rule
    alone come back to their rows.  A genitive ending stays behind the rewritten token.
    Of equal patterns the first by place, else by rewrite, wins.  A null text stays null;
    equal rows stay rows of their own.
    """
    first = F.struct("place", "rewrite") if "place" in rules.columns else F.struct(F.col("rewrite"))
    table = rules.where("kind = 'token'").groupBy("pattern").agg(F.min(first)["rewrite"].alias("rewrite"))
    size = table.agg(F.sum(F.octet_length("pattern") + F.octet_length("rewrite"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        shared = df.sparkSession.sparkContext.broadcast({r["pattern"]: r["rewrite"] for r in table.collect()})
        return df.withColumn(column, text_function(lambda t: _looked_up(t, shared.value))(F.col(column)))
    return _rewrite_by_join(df, column, table)


def _looked_up(text: str, table: dict[str, str]) -> str:
    get = table.get
    out = []
    for w in text.split(" "):
        new = get(w)
        if new is None and "'" in w and (m := _BARE.match(w)) and m[1] in table:
            new = table[m[1]] + m[2]
        out.append(w if new is None else new)
    return " ".join(out)


def _rewrite_by_join(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """As ``rewrite_tokens`` with rules of any size: texts stay rows, with the rewrites of their own tokens."""
    row = "row_number"
    while row in df.columns:
        row += "_"
    rows = checkpointed(df.withColumn(row, F.monotonically_increasing_id()))
    tokens = F.array_distinct(F.split(F.col(column), " ", -1))
    words = rows.select(row, F.explode(tokens).alias("word"))
    forms = words.select("word").distinct()
    stem, clitic = F.regexp_extract("word", "^(.*?)('[sS]?)$", 1), F.regexp_extract("word", "^(.*?)('[sS]?)$", 2)
    whole = forms.join(table.select(F.col("pattern").alias("word"), "rewrite"), "word")
    bare = forms.where(clitic != "").select("word", stem.alias("pattern"), clitic.alias("clitic")).join(table, "pattern").select("word", F.concat("rewrite", "clitic").alias("rewrite"))
    known = whole.unionByName(bare.join(whole.select("word"), "word", "left_anti"))
    mine = words.join(known, "word").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("word", "rewrite"))).alias("known"))

    @F.arrow_udf("string")
    def look_up(texts: pa.Array, maps: pa.Array) -> pa.Array:
        return pa.array([t if t is None or not m else " ".join(dict(m).get(w, w) for w in t.split(" ")) for t, m in zip(texts.to_pylist(), maps.to_pylist())], pa.string())

    return rows.join(mine, row, "left").withColumn(column, look_up(F.col(column), F.col("known"))).select(*[F.col(f"`{c}`") for c in df.columns])


def rewrite_counts(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """N-gram counts after rewriting whole n-grams: counts of equal results add up."""
    table = rules.select(F.col("pattern").alias("from"), "rewrite")
    return (
        counts.join(table, counts["ngram"] == table["from"], "left")
        .groupBy(F.coalesce("rewrite", "ngram").alias("ngram"))
        .agg(F.sum("c").alias("c"))
    )


def map_counts(counts: DataFrame, rules: RuleSet) -> DataFrame:
    """N-gram counts under rules of any kind, each of which must match a whole n-gram."""
    return counts.select(text_function(rules.apply_whole)("ngram").alias("ngram"), "c").groupBy("ngram").agg(F.sum("c").alias("c"))


#: Small hand-written sets; larger ones load from files of the same form.
UK_TO_US = """
colour => color
colours => colors
centre => center
centres => centers
programme => program
programmes => programs
organisation => organization
organise => organize
favour => favor
behaviour => behavior
analyse => analyze
theatre => theater
travelled => traveled
catalogue => catalog
defence => defense
grey => gray
"""
ABBREVIATION_RULES = r"""
etc\.? => et cetera
Mr\.? => Mister
Dr\. => Doctor
Prof\. => Professor
e\.g\. => for example
i\.e\. => that is
vs\.? => versus
"""
ABBREVIATION_RULES_FR = r"""
etc\.? => et caetera
M\.(?= [A-Z][^. ]) => Monsieur
Mme => Madame
Mlle => Mademoiselle
Pr\.? => Professeur
Dr\.? => Docteur
"""
HESITATIONS = r"""
u[hm]+ => uh
[Uu]h+ => uh
[Hh]m+ => hm
"""
ACCENTS_FR = """
Electronique => Électronique
electronique => électronique
Ecole => École
Etat => État
"""


def built_in(text: str, **options) -> RuleSet:
    return RuleSet(parse(text.strip().split("\n"), **options))


def swapped(text: str) -> RuleSet:
    """A one-to-one rule list in the other direction."""
    lines = [" => ".join(reversed(x.split(" => "))) for x in text.strip().split("\n")]
    return RuleSet(parse(lines))


__all__ = ["Rule", "RuleBook", "RuleSet", "apply_rules", "map_counts", "parse", "rewrite_counts", "rewrite_tokens", "translate"]
