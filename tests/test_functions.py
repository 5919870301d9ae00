"""Values of functions, edge cases first; expected values are written out."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.functions import ids, paths, semi, text, vectors


def one(spark, c, **values):
    names = list(values) or ["x"]
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{n} {'int' if isinstance(values.get(n), int) else 'string'}" for n in names))
    return row.select(c.alias("v")).first()["v"]


def test_lines(spark):
    f = lambda s: one(spark, text.lines(F.col("s")), s=s)
    assert f("a\r\nb\n") == ["a", "b"] and f("") == [] and f("\n") == [""] and f("a\n\nb") == ["a", "", "b"]
    assert one(spark, text.lines(F.col("s")), s=None) is None


def test_join_compact(spark):
    f = lambda most, *p: one(spark, text.join_compact([F.lit(x) for x in p], most))
    assert f(50, "fn foo()", "bar.rs", "line 10") == "fn foo() · bar.rs · line 10"
    assert f(12, "fn foo()", "bar.rs") == "fn foo() · " and f(50, "", "  ", "x") == "x"
    assert f(99, *"abcdefghi") == " · ".join("abcdefg")


def loop_normalize(s, most):
    out, blank = "", False
    ls = s.split("\n")
    for x in ls[:-1] if ls[-1] == "" else ls:
        x = x.removesuffix("\r").rstrip()
        if x == "" and blank:
            continue
        blank = x == ""
        if len(out.encode()) + len(x.encode()) + 1 > most:
            break
        out += x + "\n"
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n ", max_size=40), min_size=1, max_size=20), st.integers(0, 60))
def test_normalize_is_the_loop(spark, texts, most):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["v"] for r in df.select(text.normalize_code_light(F.col("s"), most).alias("v")).collect()]
    assert got == [loop_normalize(t, most) for t in texts]


def test_clamps(spark):
    f = lambda s, n, k: one(spark, text.clamp_ellipsis(F.col("s"), n, k), s=s)
    assert f("aa\nbb\ncc", 100, 0) == "aa\nbb\ncc" and f("aa\nbb\ncc", 5, 0) == "aa…" and f("aa\nbb", 100, 1) == "aa…"
    assert one(spark, text.clamp_ellipsis(F.col("s"), 9, 0, zero_is_all=False), s="aa") == ""
    assert one(spark, text.clamp_snippet(F.col("s"), 6, 9), s="aa\nbb\ncc") == "aa\nbb"
    assert one(spark, text.truncate(F.col("s"), 3), s="abcd") == "abc…" and one(spark, text.truncate(F.col("s"), 4), s="abcd") == "abcd"
    assert tuple(one(spark, text.maybe_truncate(F.col("s"), 2), s="abc")) == ("ab\n\n[... TRUNCATED ...]\n", True)


def test_words(spark):
    assert one(spark, text.keywords(F.col("s")), s="getUserName /api/v1/users 12345 a-b foo_bar") == sorted({"getusername", "get", "user", "name", "/api/v1/users", "api", "users", "foo_bar", "foo", "bar", "a-b"})
    assert one(spark, text.routes(F.col("s")), s="go('/home') \"/a b\" x//y /") == ["/home", "/a b", "/a", "//y"]
    assert one(spark, text.identifiers(F.col("s")), s="a1 9b _c $d a1 über") == ["a1", "_c", "$d", "über"]
    assert one(spark, text.naive_imports(F.col("s")), s="import x from 'm';\nrequire(\"n\")\nfrom a.b import c\nimport os\nuse foo::bar;\n") == ["m", "n", "py:x", "py:a.b", "py:os", "use:foo::bar"]
    assert one(spark, text.import_symbols(F.col("s")), s="import {a, b as c} from 'x'") == ["c", "a"]
    assert one(spark, text.import_symbols(F.col("s")), s="use foo::Bar;") == ["Bar"]
    assert one(spark, text.identifier_chains(F.col("s")), s="A.b C::D e") == ["A.b", "C::D", "e"]
    assert one(spark, text.parent_path(F.col("s")), s="a::b::c") == "a::b" and one(spark, text.parent_path(F.col("s")), s="a::b") is None


def test_masks_and_escapes(spark):
    f = lambda s, a, b: one(spark, text.sanitize_line_mentions(F.col("s"), F.lit(a), F.lit(b)), s=s)
    assert f("Line 5, lines 5-7 and lines 5 – 7", 5, 7) == "these lines, lines 5-7 and lines 5 – 7"
    assert f("line 5 and line 55", 5, 5) == "line 5 and these lines" and f("line 1", None, None) == "these lines"
    assert one(spark, text.xml_escape(F.col("s")), s="<a b='&'>\"") == "&lt;a b=&apos;&amp;&apos;&gt;&quot;"
    assert one(spark, text.redact_secrets(F.col("s")), s="x glpat-abcdefghijklmnop1 token = 0123456789abcdefg") == "x [REDACTED] [REDACTED]"
    assert one(spark, text.strip_think(F.col("s")), s="a<think>b\nc</think>d</think>") == "ad"
    assert one(spark, text.strip_fences(F.col("s")), s="```json\n{}\n```") == "{}"
    assert one(spark, text.hover_first_line(F.col("s")), s="```dart\n\nvoid f()\n```") == "void f()"


def test_lines_of_text(spark):
    s = "l1\nl2\nl3\nl4\n"
    assert one(spark, text.slice_lines(F.col("s"), F.lit(0), F.lit(2)), s=s) == "l1\nl2" and one(spark, text.slice_rows(F.col("s"), F.lit(1), F.lit(3)), s=s) == "l2\nl3"
    assert one(spark, text.slice_lines(F.col("s"), F.lit(9), F.lit(12)), s=s) == ""
    assert one(spark, text.anchor_window(F.col("s"), F.lit(2), F.lit(2), 1), s=s).split("\n") == ["     1 | l1", "     2 | l2", "     3 | l3"]
    assert one(spark, text.line_of(F.col("s"), F.lit(4)), s=s) == 2
    assert one(spark, text.utf16_column_to_bytes(F.col("s"), F.lit(3)), s="a😀b") == 5
    assert one(spark, text.signature_of(F.col("s")), s="int f(a) {\n x; }") == "int f(a) {"
    assert one(spark, text.excerpt(F.col("s"), 20), s="\n T \nx\n\ny") == "T — x y"


def test_paths(spark):
    assert one(spark, paths.guess_language(F.col("s")), s="a/CMakeLists.txt") == "cmake" and one(spark, paths.guess_language(F.col("s")), s="x.TSX") == "typescript"
    assert one(spark, paths.detect_language(F.col("s")), s="foo.dart") == "dart" and one(spark, paths.detect_language(F.col("s")), s="foo.yaml") is None
    assert one(spark, paths.unix_path(F.col("s")), s="lib\\src\\foo.dart") == "lib/src/foo.dart"
    assert one(spark, paths.matches_globs(F.col("s"), ["**/*.generated.dart", "[bad"]), s="lib/foo.generated.dart")
    assert not one(spark, paths.matches_globs(F.col("s"), ["*.dart"]), s="lib/foo.dart")
    assert one(spark, paths.resolve_relative(F.lit("lib/a/b.dart"), F.col("s")), s="../c.dart") == "lib/c.dart"
    assert one(spark, paths.resolve_relative(F.lit("lib/a.dart"), F.col("s")), s="package:x/y.dart") is None
    assert one(spark, paths.package_path(F.col("s"), F.lit("foo"), F.lit("p/foo/lib")), s="package:foo/x/y.dart") == "p/foo/lib/x/y.dart"
    assert one(spark, paths.repo_name(F.col("s")), s="git@h.org:team/proj.git") == "proj"
    assert one(spark, paths.looks_generated(F.col("s")), s="a/gen/x.dart") and not one(spark, paths.looks_generated(F.col("s"), False), s="a/gen/x.dart")
    assert one(spark, paths.repo_relative(F.col("s"), F.lit("/w/repo/")), s="/w/repo/lib/a.dart") == "repo/lib/a.dart"


def test_ids(spark):
    assert one(spark, ids.point_id(F.col("s")), s="abc") == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert one(spark, ids.file_id(F.lit("dart"), F.col("s")), s="a") == str(uuid.uuid5(uuid.UUID(int=0), "file|dart|a"))
    assert one(spark, ids.simhash(F.col("s")), s="a b") == 0
    a, b = (one(spark, ids.simhash(F.col("s")), s=x) for x in ("the quick brown fox jumps over the lazy dog today", "the quick brown fox jumps over the lazy dog tonight"))
    assert 0 < bin(a ^ b).count("1") < 30 and one(spark, ids.hamming(F.lit(a), F.lit(b))) == bin(a ^ b).count("1")


def test_vectors(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 1))) == 0 and one(spark, vectors.dot(arr(1, 2, 3), arr(1, 1))) == 3
    assert one(spark, vectors.euclid(arr(0, 3), arr(4, 0))) == 5
    assert vectors.fetch_k(12) == 96 and vectors.fetch_k(100) == 400 and vectors.fetch_k(500) == 500
    assert one(spark, vectors.should_escalate(F.lit("fast"), F.lit("High"), F.lit(0.5)))


def test_semi(spark):
    v = F.try_parse_json("s")
    j = '{"id": 5, "uuid": "u", "vector": [1, 2.5, "x", null, true], "a": {"b": [7, 8]}, "tags": ["t"]}'
    assert one(spark, semi.pick_str(v, ["id", "uuid"]), s=j) == "u" and one(spark, semi.pick_vector(v, ["embedding", "vector"]), s=j) == [1.0, 2.5]
    assert one(spark, semi.pointer(v, "/a/b/1", "int"), s=j) == 8 and one(spark, semi.string_list(v, "$.none"), s=j) == []
    assert one(spark, semi.parse(F.col("s")).isNull(), s="{oops")
    with pytest.raises(Exception, match="length 3 expected"):
        one(spark, semi.require_dimension(F.array(F.lit(1.0)).cast("array<float>"), 3))


def test_simhash_holds_the_tokens_of_one_text_at_a_time(spark):
    """Tasks in Python get texts, not lists of tokens; nulls, short and empty texts are 0."""
    from codestrata.functions import ids

    df = spark.createDataFrame([(0, None), (1, ""), (2, "abc de fgh"), (3, "Abc, (def) gh ijk. über\tabc"), (4, "same word " * 5000)], "i int, text string")
    out = df.select("i", ids.simhash(F.col("text")).alias("h"))
    assert "array_join(" in out._jdf.queryExecution().optimizedPlan().toString()
    want = {0: 0, 1: 0, 2: 0, 3: ids.simhash_of(["abc", "def", "ijk", "über", "abc"]), 4: ids.simhash_of(["same", "word"] * 5000)}
    assert {r["i"]: r["h"] for r in out.collect()} == want
