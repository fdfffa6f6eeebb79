import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import gotext
from sluice.functions import paths
from sluice.functions.fields import ColumnFields, ExactFields, with_exact_fields
from sluice.functions.regex import PatternError, compile_pattern
from sluice.operators.cascade import Cascade
from sluice.operators.mock import MockMatcher, MockStage, Outcome
from sluice.operators.rules import FieldMatcher, Matcher, Rule, RulesStage
from sluice.operators.schema import Field, SchemaStage
from sluice.operators.stages import Env, Gate, RowStage, StaticStage, with_gate, with_name
from sluice.sources.tables import from_memory


def records(spark, *rows):
    return from_memory(spark, [{"id": str(i), **(r if isinstance(r, dict) else {"data": r})} for i, r in enumerate(rows)])


def categories(df):
    return [r["c"] for r in df.orderBy("_line").select(F.col("decision")["category"].alias("c")).collect()]


def test_paths():
    assert paths.split("") == [] and paths.split("a..b") == ["a", "", "b"] and paths.split("/a~1b/c~0d/~01") == ["a/b", "c~d", "~1"]
    fields = {"a": {"b": None, "r": [1]}, "x.y": 3}
    assert paths.get(fields, "a.b") == (None, True)
    assert paths.get(fields, "/x.y") == (3, True)
    assert paths.get(fields, "a.r") == ([1], True)
    for missing in ("", "a.r.0", "a.z", "x.y", "a.b.c"):
        assert paths.get(fields, missing) == (None, False)
    assert paths.variant_path(["a b", 'c"d']) == "$[\"a b\"]['c\"d']"
    assert paths.variant_path(["a", "b'\"c"]) is None


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_number_texts_read_back(x):
    for text in (gotext.number(x), gotext.plain(x), gotext.json_number(x)):
        assert float(text) == x


def test_number_texts():
    assert [gotext.number(x) for x in (500, 0.7, 1e21, 1e6, 123456.0, 1234567.5, 1e-5, 0.0001, -0.0)] == [
        "500", "0.7", "1e+21", "1e+06", "123456", "1.2345675e+06", "1e-05", "0.0001", "-0",
    ]
    assert [gotext.json_number(x) for x in (1.0, 0.0, -0.0, 1e-7, 1e21, 0.000001, 123.25)] == ["1", "0", "-0", "1e-7", "1e+21", "0.000001", "123.25"]
    assert gotext.plain(1234567.0) == "1234567" and gotext.number(math.inf) == "+Inf"
    assert gotext.quote('a"\\\n\x01' + chr(0xE9)) == '"a\\"\\\\\\n\\x01' + chr(0xE9) + '"'


REFUSED = [r"a(?=b)", r"(a)\1", "a++", "(?>a)", "a{1001}", r"\Z", "a**", "*a", "(a", "a)", "[z-a]", "[a", "(?i", "(a{1000}){2}", "a\\", r"(?P<n>a)(?P<n>b)"]


@pytest.mark.parametrize("pattern", REFUSED)
def test_patterns_refused(pattern):
    with pytest.raises(PatternError):
        compile_pattern(pattern)


PATTERNS = [
    r"^PING$", "foo.bar", r"\bcat\b", "(?i)straße|K", "(?m)^x$", r"[[:alpha:]]+\d", "a{2,3}b", "x{,5}", "a{", r"(?P<n>ab)+c", r"\s\w\S", r"\pL\p{Greek}",
    r"[^a-c\d]z", r"\Qa.b\E+", "(?s)a.b", "(?U)a+b", "error|panic", r"\x41\x{42}", r"\101", "[a&&b]", "[]a]", "[a-]", r"\Bb", r"a\z", "(?i:ab)C", "é\\b",
    "[[:^space:]]x", r"\PL", "a|", "(|b)c", r"\v", r"[\]]", "(?i)a(?-i)b",
]
TEXTS = [
    "PING", "PING\n", "foo\rbar", "foobar", "a cat.", "concat", "STRASSE", "STRAßE", "k", "K", "a\nx\nb", "abc1", "aab", "x{,5}", "a{", "ababc", " a b", "\x0baé",
    "αβ", "Lα", "5z", "\nz", "a.b.b", "a.bb", "a\nb", "error here", "AB", "A", "&", "]", "-", "bb", "abC", "ABC", "éa", "x x", "1", "", "\x0b", "aB", "Ab",
]


def test_patterns_agree_with_re2(spark):
    import duckdb

    con = duckdb.connect()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    found = df.select("i", *(compile_pattern(p).matches(F.col("t")).alias(f"p{k}") for k, p in enumerate(PATTERNS))).collect()
    for r in found:
        for k, p in enumerate(PATTERNS):
            assert r[f"p{k}"] == con.execute("SELECT regexp_matches(?::VARCHAR, ?)", [TEXTS[r["i"]], p]).fetchone()[0], (p, TEXTS[r["i"]])


def test_literal_patterns():
    assert compile_pattern(r"a\.b").literal and compile_pattern(r"a\.b").required == "a.b"
    assert not compile_pattern("^ab").literal and compile_pattern("^ab").required == "ab"
    assert compile_pattern("(?i)ab").required == "" and compile_pattern("ab|c").required == "" and compile_pattern("abc?").required == "ab"


def test_first_rule_wins_and_blocks_combine(spark):
    stage = RulesStage([
        Rule("both", contains=["a", "b"], any=[Matcher(contains="c"), Matcher(regex="d$")], all=[Matcher(contains="e")]),
        Rule("late", "id", regex=["^x"]),
        Rule("any", contains=["x"]),
    ])
    done = Cascade([stage]).classify(records(spark, "ace", "be d", "ac", "xa", "ax", "A"))
    assert categories(done) == ["both", "both", None, "late", "any", None]
    first = done.orderBy("_line").first()["decision"]
    assert (first["confidence"], first["stage"], first["reasons"][0]["code"]) == (1.0, "rules", "both")
    assert first["reasons"][0]["detail"] == 'contains "a" or contains "b" and any(contains "c" or regex "d$") and all(contains "e")'


FIELD_CASES = [
    (dict(exact="404"), {"a": 404}, True), (dict(exact="404"), {"a": "404"}, True), (dict(exact="true"), {"a": True}, True), (dict(exact=""), {"a": ""}, True),
    (dict(exact="x"), {}, False), (dict(exact="x"), None, False), (dict(exact="[1]"), {"a": [1]}, False), (dict(exact="null"), {"a": None}, False),
    (dict(contains="04"), {"a": 404}, True), (dict(regex="^4.4$"), {"a": 404}, True), (dict(regex=""), {"a": "z"}, True), (dict(regex=""), {}, False),
    (dict(gt=1.0), {"a": 1}, False), (dict(gte=1.0), {"a": 1}, True), (dict(lt=2.0), {"a": 1.5}, True), (dict(lte=1.0), {"a": 1}, True),
    (dict(gt=1.0), {"a": "12"}, False), (dict(gt=0.0), {"a": True}, False), (dict(lt=5.0), {"a": None}, False), (dict(exact="1234567"), {"a": 1234567.0}, True),
    (dict(exists=True), {"a": None}, True), (dict(exists=True), {}, False), (dict(exists=False), {}, True), (dict(exists=False), None, False), (dict(exists=True), None, False),
    (dict(exact="9007199254740993"), {"a": 9007199254740993}, True),
]


def test_field_matchers(spark):
    rules = [[Rule("hit", fields=[FieldMatcher("a", **m)])] for m, _, _ in FIELD_CASES]
    df = records(spark, *({"fields": f} for _, f, _ in FIELD_CASES))
    for i, (m, f, want) in enumerate(FIELD_CASES):
        got = categories(Cascade([RulesStage(rules[i])]).classify(df.where(F.col("id") == str(i))))
        assert got == ["hit" if want else None], (m, f)


def test_exact_fields_keep_number_text(spark):
    df = records(spark, {"data": '{"n":1.10,"m":{"x":1e400}}'}, {"data": '{"n":1e10}'}, {"data": "{"})
    df = with_exact_fields(df, ["n", "m.x", "m"])
    env = Env(fields=ExactFields())
    stage = RulesStage([Rule("a", fields=[FieldMatcher("n", exact="1.10")]), Rule("b", fields=[FieldMatcher("n", exact="1e10")])])
    assert categories(Cascade([stage], env=env).classify(df)) == ["a", "b", None]
    big = RulesStage([Rule("big", fields=[FieldMatcher("m.x", gt=0.0)]), Rule("object", fields=[FieldMatcher("m", exists=True)])])
    assert categories(Cascade([big], env=env).classify(df)) == ["object", None, None]


BAD_RULES = [
    ([], "rules: at least one rule is required"),
    ([Rule("")], "rules: rule 1: category is required"),
    ([Rule("c")], "rules: rule 1 (c): at least one matcher (contains/regex/fields/any/all) is required"),
    ([Rule("c", "i", contains=[""])], "rules: rule 1 (i): empty contains matcher"),
    ([Rule("c", regex=[""])], "rules: rule 1 (c): empty regex matcher (matches everything)"),
    ([Rule("c", regex=["("])], "rules: rule 1 (c): error parsing regexp: missing closing ): `(`"),
    ([Rule("c", fields=[FieldMatcher(exact="x")])], "rules: rule 1 (c): field matcher needs a path"),
    ([Rule("c", fields=[FieldMatcher("p")])], 'rules: rule 1 (c): field "p" needs exactly one of exact/contains/regex/exists/gt/gte/lt/lte'),
    ([Rule("c", fields=[FieldMatcher("p", contains="")])], 'rules: rule 1 (c): field "p": empty contains matcher'),
    ([Rule("c", any=[Matcher("a", "b")])], "rules: rule 1 (c): each any/all matcher needs exactly one of contains/regex/field"),
]


@pytest.mark.parametrize(("rules", "message"), BAD_RULES)
def test_rules_refused(rules, message):
    with pytest.raises(ValueError) as e:
        RulesStage(rules)
    assert str(e.value) == message


def test_schema(spark):
    stage = SchemaStage("bad", [Field("a", True, "number"), Field("b", False, "string"), Field("c.d", True, "bool"), Field("e")])
    df = records(spark, {"fields": {"a": 1, "b": "x", "c": {"d": True}}}, {"fields": {"a": "1", "b": None, "c": 5}}, {"fields": None})
    done = Cascade([stage]).classify(df).orderBy("_line").collect()
    assert done[0]["decision"] is None
    assert [tuple(r) for r in done[1]["decision"]["reasons"]] == [("type", "field a is not a number"), ("type", "field b is not a string"), ("missing", "required field c.d is missing")]
    assert [r["code"] for r in done[2]["decision"]["reasons"]] == ["missing", "missing"]
    for bad in (("", [Field("a")]), ("c", []), ("c", [Field("")]), ("c", [Field("a", type="int")])):
        with pytest.raises(ValueError):
            SchemaStage(*bad)


def test_mock(spark):
    stage = MockStage([MockMatcher(["x", "y"], "a", 0.85), MockMatcher(["z"], "b", 0.0)], Outcome("d", 1.0))
    done = Cascade([stage]).classify(records(spark, "zy", "z", "q")).orderBy("_line").collect()
    assert [(r["decision"]["category"], r["decision"]["confidence"]) for r in done] == [("a", 0.85), ("b", 0.0), ("d", 1.0)]
    assert tuple(done[0]["decision"]["reasons"][0]) == ("mock", 'mock score 0.85 for "a"')
    for bad, said in ((([],), "at least one matcher"), (([MockMatcher([], "a", 1)],), "contains is required"), (([MockMatcher([""], "a", 1)],), "empty string"),
                      (([MockMatcher(["a"], "", 1)],), "is invalid"), (([MockMatcher(["a"], "b", 1.5)],), "is invalid"), (([], Outcome("a", math.nan)), "is invalid")):
        with pytest.raises(ValueError, match=said):
            MockStage(*bad)


def test_gates_names_and_escalation(spark):
    mock = MockStage([MockMatcher(["x"], "low", 0.6), MockMatcher(["y"], "high", 0.9)], Outcome("rest", 0.1))
    df = records(spark, "x", "y", "z")
    assert categories(Cascade([mock], 0.6).classify(df)) == ["low", "high", None]
    assert categories(Cascade([with_gate(mock, Gate(0.7)), with_name(mock, "again")]).classify(df)) == ["low", "high", "rest"]
    done = Cascade([with_gate(mock, Gate(0.7)), with_name(mock, "again")]).classify(df).orderBy("_line").collect()
    assert [r["decision"]["stage"] for r in done] == ["again", "mock", "again"]
    assert Gate(0.0).admits(0.0) and Gate(0.5).admits(0.5) and not Gate(0.5).admits(0.4)
    for bad in (-0.1, 1.1, math.nan):
        with pytest.raises(ValueError, match=r"min confidence must be within \[0, 1\]"):
            Gate(bad)
    for stages, said in (([], "at least one stage"), ([None], "stage 0 is nil"), ([mock, mock], 'duplicate stage name "mock"'), ([with_name(mock, "")], "must not be empty")):
        with pytest.raises(ValueError, match=said):
            Cascade(stages)


def test_row_stages_see_undecided_records_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def ask(rows):
        seen.add(len(rows))
        answers = {b"bad": ("", 0.5), b"err": RuntimeError("boom"), b"low": ("l", 0.1), b"ok": ("o", 0.9, [("why", "so")])}
        return [answers.get(r["data"]) for r in rows]

    stages = [RulesStage([Rule("first", contains=["first"])]), RowStage("model", ask), MockStage(default=Outcome("last", 1.0))]
    done = Cascade(stages, 0.5).classify(records(spark, "first", "bad", "err", "low", "ok", "none", "first")).collect()
    done.sort(key=lambda r: r["_line"])
    assert [r["decision"] and r["decision"]["category"] for r in done] == ["first", None, None, "last", "o", "last", "first"]
    assert done[1]["error"]["message"] == 'stage model: invalid classification: category="" confidence=0.5'
    assert done[2]["error"]["message"] == "stage model: boom"
    assert tuple(done[4]["decision"]["reasons"][0]) == ("why", "so")
    assert seen.value == 5


def test_nan_confidence_is_an_error(spark):
    done = Cascade([RowStage("m", lambda rows: [("c", math.nan)] * len(rows))], 0.7).classify(records(spark, "a")).first()
    assert done["decision"] is None and "confidence=NaN" in done["error"]["message"]


def test_static(spark):
    done = Cascade([StaticStage("s", {"a": "A", "": "empty"})]).classify(records(spark, "a", "aa", ""))
    assert categories(done) == ["A", None, "empty"]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 129])
def test_partitions_do_not_matter(spark, n):
    df = records(spark, *(f"line {i}" for i in range(n)))
    cascade = Cascade([RulesStage([Rule("seven", contains=["7"])]), MockStage([MockMatcher(["3"], "three", 0.5)])])
    assert categories(cascade.classify(df.repartition(5))) == categories(cascade.classify(df.coalesce(1)))


def test_batches_keep_order_and_errors(spark):
    stage = RowStage("m", lambda rows: [RuntimeError("no") if b"3" in r["data"] else ("c", 0.5) if b"1" in r["data"] else None for r in rows])
    rows = [{"id": str(i), "data": str(i)} for i in range(30)]
    one, many = (Cascade([stage]).classify_batch(spark, rows, n) for n in (1, 8))
    assert one == many and len(one) == 30
    assert [d and d["category"] for d, _ in one[:4]] == [None, "c", None, None] and one[3][1] == "stage m: no"
    assert Cascade([stage]).classify_batch(spark, []) == []


def test_typed_columns_read_like_variants(spark):
    rows = [(1, 1.5, "x", True, (7, None)), (None, 2.0, None, None, None), (500, float("inf"), "404", False, (0, "q"))]
    df = spark.createDataFrame(rows, "n int, v double, s string, b boolean, o struct<k:long,t:string>")
    rules = [Rule(f"r{i}", fields=[m]) for i, m in enumerate([
        FieldMatcher("n", exact="500"), FieldMatcher("v", exact="2"), FieldMatcher("b", exact="true"), FieldMatcher("o.k", gte=7.0), FieldMatcher("/o/t", contains="q"),
        FieldMatcher("s", gt=1.0), FieldMatcher("v", gt=1e300), FieldMatcher("o", exact="x"), FieldMatcher("n", exists=False), FieldMatcher("z", exists=True), FieldMatcher("o.k.x", exists=True),
        FieldMatcher("s", regex="^4"),
    ])]
    want = {"r0": [2], "r1": [1], "r2": [0], "r3": [0], "r4": [2], "r5": [], "r6": [], "r7": [], "r8": [1], "r9": [], "r10": [], "r11": [2]}
    df = df.withColumn("data", F.lit(b"")).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    for r in rules:
        done = Cascade([RulesStage([r])], env=Env(fields=ColumnFields(df.schema))).classify(df)
        assert [x["i"] for x in done.where("decision is not null").orderBy("i").collect()] == want[r.category], r
    schema = SchemaStage("bad", [Field("n", True, "number"), Field("s", False, "number"), Field("o.k", True, "number")])
    done = Cascade([schema], env=Env(fields=ColumnFields(df.schema))).classify(df).orderBy("i").collect()
    assert [[x["detail"] for x in r["decision"]["reasons"]] for r in done] == [
        ["field s is not a number"], ["required field n is missing", "required field o.k is missing"], ["field s is not a number"],
    ]
