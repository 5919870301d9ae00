"""Vector measures in double precision, and scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return _fold(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norms = norm(x) * norm(y)
    return F.when(norms > 0, dot(x, y) / norms).otherwise(F.lit(0.0))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def idf(n: Column, df: Column) -> Column:
    return 1 + F.log(1 + n / df)


def confidence(body: Column, prompt_chars: Column, patch_stripped: Column) -> Column:
    """0.6, more for code in the body and for over 300 bytes, less for long prompts and lost patches, within 0 to 1."""
    code = F.when(F.contains(body, F.lit("```")) | F.contains(body, F.lit("::")) | F.contains(body, F.lit("()")), 0.15).otherwise(0.0)
    raw = 0.6 + code + F.when(F.octet_length(body) > 300, 0.05).otherwise(0.0) - F.when(prompt_chars > 20000, 0.05).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw) - F.when(patch_stripped, 0.2).otherwise(0.0))


def approx_tokens(c: Column) -> Column:
    return F.floor(F.char_length(c) / 4)


#: Ranks.
SEVERITY_RANK = {"Low": 1, "Medium": 2, "High": 3}
LABEL_PRIORITY = {"calls": 6, "declares": 5, "extends": 4, "implements": 4, "inherits": 4, "uses": 3, "decorates": 3, "imports": 2, "exports": 2, "reexports": 2, "imports_via_export": 2, "part": 1, "routes_to": 1, "same_file": 1}


def rank_of(table: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(0))


@dataclass
class Policy:
    """When a slow model may be asked: at most ``most`` times, for findings of ``severity`` or above."""

    enabled: bool = True
    most: int = 40
    severity: str = "Medium"
    confidence: float = 0.7
    long_prompt: int = 2500

    def open(self, severity_rank: Column, used: Column) -> Column:
        return F.lit(self.enabled) & (used < self.most) & (severity_rank >= SEVERITY_RANK[self.severity])


def initial_route(prompt_tokens: Column, target_kind: Column, span: Column, used: Column | None = None, policy: Policy | None = None) -> Column:
    """fast or slow: slow for long prompts, symbols and ranges of 80 lines or more, where the policy is open for the
    severity to be expected (High for symbols and ranges of 60 lines or more, Medium for other ranges and lines)."""
    policy, used = policy or Policy(), F.lit(0) if used is None else used
    wide = lambda n: (target_kind == "range") & (F.coalesce(span, F.lit(0)) >= n)
    expected = F.when((target_kind == "symbol") | wide(60), 3).when(target_kind.isin("range", "line"), 2).otherwise(1)
    return F.when(policy.open(expected, used) & ((prompt_tokens > policy.long_prompt) | (target_kind == "symbol") | wide(80)), "slow").otherwise("fast")


def should_escalate(route: Column, severity: Column, confidence_: Column, prompt_tokens: Column | None = None, used: Column | None = None, policy: Policy | None = None) -> Column:
    """After a fast answer: where the policy is open for its severity, if it has little confidence or a long prompt."""
    policy, used = policy or Policy(), F.lit(0) if used is None else used
    long = F.lit(False) if prompt_tokens is None else prompt_tokens > policy.long_prompt
    return (route == "fast") & policy.open(rank_of(SEVERITY_RANK, severity), used) & ((confidence_ < policy.confidence) | long)


def fetch_k(k: int) -> int:
    """How many rows a top-k search over-fetches."""
    return max(min(8 * k, 400), k)


def scroll_limit(k: int) -> int:
    return max(min(80 * k, 4000), k)
