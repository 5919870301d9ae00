"""Secret scan: fixed patterns, then probabilistic automata learnt from what those patterns found.

One pass over the texts finds the base matches (three fixed patterns) and all candidates: runs of at least
``MIN_CANDIDATE`` token characters, and the parts of such runs between ``= / :`` and the like. From a bounded sample of
distinct matched credentials of each kind (``sample``, the smallest hashes) a prefix tree is built, and states whose end
and symbol frequencies agree under a Hoeffding bound are merged (a state-merging grammar inference) into a probabilistic
automaton. Background automata come the same way from candidates that no pattern matched, one for those with a digit and
one for those without. Every base match and every candidate is scored by the mean log-odds per character of the best
credential automaton against the better background. Candidates at or above the level that ``recall`` of the labelled
credentials reach when scored by automata that have not seen them, and above 0, are added as spans of kind ``format``; of
a run and its parts the best is. Base spans always stay, whatever their score.

Defined cases: a null text is the empty one; offsets count code points; a candidate that overlaps a base span is not
added again; credentials of over ``longest`` characters are not learnt from, but scored; of equal scores the earlier, then
longer candidate stays; with no labelled credentials nothing is added and scores are null; a very long text is one row of
spans; repeated rows give the same spans each; a null id is kept; an empty table gives an empty result; columns other than
the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm.common import store, table

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 characters or more
KINDS = ("assign", "access", "hex", "format")
MIN_ASSIGN, MIN_ACCESS, MIN_CANDIDATE = 12, 18, 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
#: A part of a run: it goes up to a character that stands between parts.
PART = re.compile(rf"[A-Za-z0-9+_-]{{{MIN_CANDIDATE},}}")
DIGIT = re.compile(r"[0-9]")


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential), by start, then kind."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, run) of all runs and their parts, without those that overlap a base match."""
    found = []
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        found.append((at, m.end(), run))
        found += [(at + p.start(), at + p.end(), p[0]) for p in PART.finditer(run) if len(p[0]) < len(run)]
    # Base matches come by start: merged, they are disjoint, and only the last that begins before a span ends can meet it.
    starts, ends = [], []
    for _, lo, hi, _ in base:
        if ends and lo < ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            starts.append(lo)
            ends.append(hi)
    free = lambda lo, hi: not (at := bisect_left(starts, hi)) or ends[at - 1] <= lo
    return [c for c in found if free(c[0], c[1])] if base else found


def best_of(found: list[tuple[float, int, int]]) -> list[int]:
    """Which of scored spans (score, start, end) stay where some overlap: the best, then the earlier, then the longer.

    What stays is disjoint, so that a span has two neighbours to be held against: the work is that of sorting."""
    kept: list[tuple[int, int, int]] = []
    for k in sorted(range(len(found)), key=lambda k: (-found[k][0], found[k][1], -found[k][2])):
        _, lo, hi = found[k]
        at = bisect_left(kept, (hi,))
        if not at or kept[at - 1][1] <= lo:
            kept.insert(at, (lo, hi, k))
    return sorted(k for _, _, k in kept)


class Automaton:
    """A probabilistic deterministic automaton, inferred from strings by merging compatible prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.arcs: list[dict[str, int]] = [{}]
        self.ends, self.seen = [0], [0]
        self.symbols = Counter(chain.from_iterable(strings))
        self.n_symbols = sum(self.symbols.values())
        for s in strings:
            at = 0
            for c in s:
                self.seen[at] += 1
                self.arcs[at][c] = self.arcs[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.arcs.append({})
                    self.ends.append(0)
                    self.seen.append(0)
                at = self.next[at][c]
            self.seen[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n1, n2 = self.seen[a], self.seen[b]
            if not n1 or not n2:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                if self._differ(self.arcs[a].get(c, 0), n1, self.arcs[b].get(c, 0), n2):
                    return False
            # Below a certain count the bound tells nothing apart.
            stack += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a] and self.seen[t] > 4]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the state a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, t in self.next[b].items():
                self.arcs[a][c] = self.arcs[a].get(c, 0) + self.arcs[b][c]
                if c in self.next[a]:
                    stack.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_states(self) -> None:
        red, queue = [0], sorted((c, 0) for c in self.next[0])
        while queue:
            c, parent = queue.pop(0)
            blue = self.next[parent][c]
            if blue in red:
                continue
            into = next((r for r in red if self._compatible(r, blue)), None)
            if into is None:
                red.append(blue)
                queue += sorted((d, blue) for d in self.next[blue])
            else:
                self.next[parent][c] = into
                known = set(red)
                before = {(d, r) for r in red for d, t in self.next[r].items() if t not in known}
                self._fold(into, blue)
                after = {(d, r) for r in red for d, t in self.next[r].items() if t not in known}
                queue += sorted(after - before)
        keep = {r: i for i, r in enumerate(red)}
        self.arcs, self.ends, self.seen = [self.arcs[r] for r in red], [self.ends[r] for r in red], [self.seen[r] for r in red]
        self.next = [{c: keep[t] for c, t in self.next[r].items() if t in keep} for r in red]

    def symbol(self, c: str) -> float:
        """How likely a symbol is whatever the state; those never seen share one count over 70 symbols."""
        return (self.symbols.get(c, 0) + 1 / 71) / (self.n_symbols + 1)

    def logp(self, s: str) -> float:
        """Log-probability; a state's own counts and one of the symbol's frequency; behind the last state only that."""
        at, total = 0, 0.0
        for c in s:
            if at is None:
                total += math.log(self.symbol(c))
                continue
            total += math.log((self.arcs[at].get(c, 0) + self.symbol(c)) / (self.seen[at] + 1))
            at = self.next[at].get(c)
        return total + (math.log((self.ends[at] + 1 / 71) / (self.seen[at] + 1)) if at is not None else -math.log(71))


class Formats:
    """Automata of credentials by kind, a background, and the level from which a candidate counts."""

    def __init__(self, labelled: dict[str, list[str]], background: list[str], recall: float = 0.95):
        # The level comes from credentials that the automata which score them have not seen: two halves, crosswise.
        unseen = []
        for half in (0, 1):
            self._fit({k: v[half::2] for k, v in labelled.items()}, background[half::2])
            unseen += [self.score(s) for v in labelled.values() for s in v[1 - half :: 2]]
        self._fit(labelled, background)
        known = sorted(x for x in unseen if x > -math.inf)
        self.level = max(0.0, known[int((1 - recall) * len(known))]) if known else math.inf

    def _fit(self, labelled: dict[str, list[str]], background: list[str]) -> None:
        self.kinds = {k: Automaton(v) for k, v in labelled.items() if v}
        parts = [[s for s in background if bool(DIGIT.search(s)) == digit] for digit in (False, True)]
        self.backgrounds = [Automaton(x) for x in parts if x] or [Automaton([])]
        # Unmatched credentials of a known format are no background: learn it again without what already looks like one.
        rest = [[s for s in x if self.score(s) < 0] for x in parts]
        self.backgrounds = [Automaton(x) for x in rest if x] or [Automaton([])]

    def score(self, s: str) -> float:
        if not self.kinds:
            return -math.inf
        return (max(a.logp(s) for a in self.kinds.values()) - max(a.logp(s) for a in self.backgrounds)) / (len(s) + 1)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and candidates (arrays of kind, start, end, value), for every document."""

    def run(batches):
        for b in batches:
            base, more = [], []
            for t in b.column("_text").to_pylist():
                t = t or ""
                found = base_matches(t)
                base.append([dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in found])
                more.append([{"kind": "format", "start": s, "end": e, "value": v} for s, e, v in candidates(t, found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.list_(SPAN)), pa.array(more, pa.list_(SPAN))], names=["doc_id", "base", "candidates"])

    span = "array<struct<kind:string,start:int,end:int,value:string>>"
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, base {span}, candidates {span}")


def learn(scanned: DataFrame, sample: int = 300, longest: int = 128, recall: float = 0.95) -> Formats:
    """Formats from at most ``sample`` distinct credentials of each kind, of up to ``longest`` characters, and four
    times as many unmatched candidates with and without a digit."""

    def some(df: DataFrame) -> list:
        top = df.select(F.concat("s.kind", F.when((F.col("s.kind") == "format") & F.col("s.value").rlike("[0-9]"), "-digit").otherwise("")).alias("kind"), "s.value")
        top = top.filter(F.length("value") <= longest).distinct()
        kinds = {"assign": sample, "access": sample, "hex": sample, "format": 4 * sample, "format-digit": 4 * sample}
        return [r for k, n in kinds.items() for r in top.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(n).collect()]

    labelled: dict[str, list[str]] = {}
    for r in some(scanned.select(F.explode("base").alias("s"))):
        labelled.setdefault(r["kind"], []).append(r["value"])
    other = [r["value"] for r in some(scanned.select(F.explode("candidates").alias("s")))]
    return Formats(labelled, other, recall)


def find(docs: DataFrame, sample: int = 300, recall: float = 0.95, **columns: str) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and spans (all, each with its score)."""
    scanned = store(scan(docs, **columns), "secret-scan")
    shared = docs.sparkSession.sparkContext.broadcast(learn(scanned, sample, recall=recall))  # bounded by `sample`

    def run(batches):
        formats, known = shared.value, {}

        def score(value: str) -> float:
            if value not in known:
                if len(known) > 200_000:
                    known.clear()
                known[value] = formats.score(value)
            return known[value]

        for b in batches:
            base, spans = b.column("base").to_pylist(), []
            for own, more in zip(base, b.column("candidates").to_pylist(), strict=True):
                for c in chain(own, more):
                    c["score"] = score(c["value"]) if formats.kinds else None
                added = [c for c in more if formats.kinds and c["score"] >= formats.level]
                added = [added[k] for k in best_of([(c["score"], c["start"], c["end"]) for c in added])]
                spans.append(sorted([*own, *added], key=lambda x: (x["start"], KINDS.index(x["kind"]))))
            kind = pa.list_(pa.struct([*SPAN, pa.field("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("base"), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int,value:string>>"
    return scanned.mapInArrow(run, f"doc_id {dict(scanned.dtypes)['doc_id']}, base {span}, spans {span[:-2]},score:double>>")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def digest(matches: list[tuple[str, int, int, str]]) -> str:
    """base_sha256 of one document, in Python."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in matches).encode()).hexdigest()
