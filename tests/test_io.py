import contextlib
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.functions import logfields
from sluice.functions.wire import wire_line
from sluice.functions.wordpiece import WordPiece, encode_column
from sluice.model import SinkError, SourceError, StageError
from sluice.operators.cascade import Cascade
from sluice.operators.mock import MockMatcher, MockStage, Outcome
from sluice.operators.rules import Matcher, Rule, RulesStage
from sluice.operators.sinks import Drop, JsonLines, JsonLinesFolder, Memory, Router
from sluice.operators.stages import RowStage
from sluice.plans.engine import Engine
from sluice.sources import lines
from sluice.sources.tables import from_memory
from sluice.streaming.run import line_stream, run_stream

ALL = Cascade([MockStage(default=Outcome("all", 1.0))])


def written(tmp_path, text, name="f.txt"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{path}"


def test_text_lines(spark, tmp_path):
    rows = lines.read_text(spark, written(tmp_path, "a\r\n\nb\rc\nlast"), "n").orderBy("_line").collect()
    assert [(r["id"], bytes(r["data"]), r["kind"]) for r in rows] == [("n:1", b"a", "text"), ("n:2", b"", "text"), ("n:3", b"b\rc", "text"), ("n:4", b"last", "text")]
    assert lines.read_text(spark, written(tmp_path, "", "e.txt"), "n").count() == 0


def test_line_numbers_over_many_blocks(spark, tmp_path):
    path = written(tmp_path, "".join(f"line {i}\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        found = lines.read_text(spark, path, "n")
        assert found.where(F.concat(F.lit("line "), F.col("_line").cast("string")) != F.col("data").cast("string")).count() == 0
        assert found.agg(F.countDistinct("_line")).first()[0] == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_lines_are_errors(spark, tmp_path):
    rows = lines.read_text(spark, written(tmp_path, "x" * (1 << 20) + "\n" + "y" * 200_000), "n").orderBy("_line").collect()
    assert "token too long" in rows[0]["source_error"]["message"] and rows[1]["source_error"] is None


BAD = ["{} x", "{}}", "{}]", "{}{}", "[1]", "5", '"s"', "null", "{", '{"a":01}', "{'a':1}"]


def test_jsonl(spark, tmp_path):
    text = "\n".join(['{"a":9007199254740993}', "   ", *BAD, ' {"z":{},"a":[1]} '])
    rows = lines.read_jsonl(spark, written(tmp_path, text), "j").select("id", "source_error", F.to_json("fields").alias("f")).orderBy("_line").collect()
    assert [r["id"] for r in rows] == ["j:1", *(f"j:{i}" for i in range(3, 4 + len(BAD)))]
    assert rows[0]["f"] == '{"a":9007199254740993}' and rows[-1]["source_error"] is None
    for r in rows[1:-1]:
        assert r["source_error"]["message"].startswith(f"jsonl: {r['id']}: ") and r["f"] is None
    assert "unexpected data" in rows[1]["source_error"]["message"] and "not a JSON object" in rows[5]["source_error"]["message"]


def wire(spark, record, cascade=ALL, exact=False):
    return cascade.classify(from_memory(spark, [record])).select(wire_line(exact=exact).alias("line")).first()["line"]


def test_wire_lines(spark):
    text = "".join(map(chr, range(0x20))) + '"\\/<>&\x7f' + "".join(map(chr, (0x2028, 0x2029, 0xE9, 0x1F600)))
    line = wire(spark, {"id": "a", "kind": "event", "data": text, "fields": {"b": {"d": [1, None, True], "c": "x" + chr(0x1F) + chr(0x2028)}, "a": 1}, "meta": {"k2": "v", "k1": '"'}})
    back = json.loads(line)
    assert back["data"] == text and list(back) == ["id", "kind", "data", "fields", "meta", "category", "confidence", "stage", "reasons"]
    escapes = ["u0000", "u0001", "b", "t", "n", "u000b", "f", "r", "u000e", "u2028", "u2029", "u001f"]
    assert all("\\" + e in line for e in escapes) and "<>&\x7f" in line and chr(0x2028) not in line
    assert list(back["fields"]) == ["a", "b"] and list(back["meta"]) == ["k1", "k2"]
    assert wire(spark, {"id": "t", "kind": "text", "data": "x", "fields": {}, "meta": {}}) == (
        '{"id":"t","data":"x","category":"all","confidence":1,"stage":"mock","reasons":[{"code":"mock","detail":"mock score 1 for \\"all\\""}]}'
    )
    none = Cascade([RulesStage([Rule("never", contains=["never"])])])
    assert wire(spark, {"id": "r", "data": "x"}, none) == '{"id":"r","data":"x","category":"","confidence":0}'


def test_wire_bad_bytes_and_numbers(spark):
    assert '"data":"a\\ufffdb"' in wire(spark, {"id": "a", "data": b"a\xffb"})
    assert '"data":"\\ufffd\\ufffdb"' in wire(spark, {"id": "a", "data": b"\xe2\x82b"}, exact=True)
    assert '"fields":{"b":[1.10,1E5],"c":1e400}' in wire(spark, {"id": "a", "kind": "json", "data": '{"c":1e400,"b":[1.10,1E5]}'}, exact=True)
    said = ((0.85, "0.85"), (0.25, "0.25"), (1e-7, "1e-7"), (1.5e-9, "1.5e-9"), (1e-6, "0.000001"), (1.25e-5, "0.0000125"), (0.0001, "0.0001"), (0.001, "0.001"), (1 / 3, "0.3333333333333333"), (2.5e-10, "2.5e-10"))
    for confidence, text in said:
        for exact in (False, True):
            assert f'"confidence":{text},' in wire(spark, {"id": "a", "data": "x"}, Cascade([MockStage(default=Outcome("c", confidence))]), exact)


def memory(spark, *texts):
    return from_memory(spark, [{"id": f"m:{i}", "data": t} for i, t in enumerate(texts, 1)])


def test_engine_routes_and_counts(spark):
    cascade = Cascade([RulesStage([Rule("a", contains=["a"]), Rule("b", contains=["b"])]), MockStage([MockMatcher(["c"], "c", 0.5)])])
    rest, a, review = Memory(), Memory(), Memory()
    stats = Engine(memory(spark, "a", "b", "c", "d", "ab"), cascade, Router(rest, {"a": a, "b": Drop()}), review).run()
    assert str(stats) == "processed=5 classified=4 review=1 by_stage=map[mock:1 rules:3]"
    assert [r["id"] for r in a.entries()] == ["m:1", "m:5"] and [r["id"] for r in rest.entries()] == ["m:3"] and [r["id"] for r in review.entries()] == ["m:4"]


def test_engine_commits_the_records_before_an_error(spark):
    def ask(rows):
        return [RuntimeError("boom") if r["data"].startswith(b"bad") else ("ok", 1.0) for r in rows]

    out = io.StringIO()
    engine = Engine(memory(spark, "x1", "x2", "bad1", "x3", "bad2"), Cascade([RowStage("m", ask)]), JsonLines(out))
    with pytest.raises(StageError, match="stage m: boom"):
        engine.run()
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == ["m:1", "m:2"]
    assert (engine.stats.processed, engine.stats.classified) == (3, 2)


def test_engine_stops_at_bad_lines(spark, tmp_path):
    out = Memory()
    engine = Engine(lines.read_jsonl(spark, written(tmp_path, '{"a":1}\n{"a":2}\nx\n{"a":3}\n'), "j"), ALL, out)
    with pytest.raises(SourceError, match="j:3"):
        engine.run()
    assert [r["id"] for r in out.entries()] == ["j:1", "j:2"] and engine.stats.processed == 2


class Broken:
    written = 0

    def write(self, df):
        raise OSError("disk full")


class Breaks(io.StringIO):
    def write(self, text):
        if len(self.getvalue().splitlines()) == 2:
            raise OSError("disk full")
        return super().write(text)


def test_counts_after_a_sink_fails(spark):
    cascade = Cascade([RulesStage([Rule("x", contains=["x"])])])
    source = memory(spark, "-", "x1", "-", "x2", "x3", "-")
    review = Memory()
    engine = Engine(source, cascade, Broken(), review)
    with pytest.raises(SinkError, match="engine: sink: disk full"):
        engine.run()
    assert str(engine.stats) == "processed=2 classified=0 review=1 by_stage=map[]" and [r["id"] for r in review.entries()] == ["m:1"]
    review = Memory()
    engine = Engine(source, cascade, JsonLines(Breaks()), review)
    with pytest.raises(SinkError):
        engine.run()
    assert str(engine.stats) == "processed=5 classified=2 review=2 by_stage=map[rules:2]" and [r["id"] for r in review.entries()] == ["m:1", "m:3"]
    engine = Engine(source, cascade, Memory(), Broken())
    with pytest.raises(SinkError, match="engine: review sink: disk full"):
        engine.run()
    assert engine.stats.classified == 3 and engine.stats.reviewed == 1


def test_engine_without_holding(spark, tmp_path):
    source = lines.read_text(spark, written(tmp_path, "a\nx\nb\n"), "t")
    out, review = Memory(), Memory()
    stats = Engine(source, Cascade([RulesStage([Rule("x", contains=["x"])])]), out, review, hold=False).run()
    assert str(stats) == "processed=3 classified=1 review=2 by_stage=map[rules:1]"
    assert [r["id"] for r in out.entries()] == ["t:2"] and [r["id"] for r in review.entries()] == ["t:1", "t:3"]


def test_lines_of_a_folder_have_ids_of_their_own(spark, tmp_path):
    for name, text in (("1", "a\nb\n"), ("2", "c\nd\n")):
        (tmp_path / name).write_text(text)
    rows = lines.read_text(spark, f"file://{tmp_path}", "d").orderBy("_line").collect()
    assert [(r["id"], bytes(r["data"])) for r in rows] == [("d:1", b"a"), ("d:2", b"b"), ("d:3", b"c"), ("d:4", b"d")]


@pytest.mark.parametrize("kind", ["stage", "line"])
def test_errors_end_a_stream(spark, tmp_path, kind):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"a":1}\n\n{"a":2}\n' + ("nothing\n" if kind == "line" else '{"bad":1}\n') + '{"a":3}\n')

    def ask(rows):
        return [RuntimeError("boom") if b"bad" in r["data"] else ("ok", 1.0) for r in rows]

    out = Memory()
    query, stats = run_stream(line_stream(spark, f"file://{source}"), Cascade([RowStage("m", ask)]), out, f"file://{tmp_path}/progress", kind="jsonl")
    with pytest.raises(Exception, match="1.jsonl:4: line is not valid JSON" if kind == "line" else "engine: stage m: boom"):
        query.awaitTermination()
    assert [r["id"].rpartition("/")[2] for r in out.entries()] == ["1.jsonl:1", "1.jsonl:3"]
    assert (stats.processed, stats.classified, stats.reviewed) == (3 if kind == "stage" else 2, 2, 0)


def test_engine_needs_its_parts(spark):
    for args, said in (((None, ALL, Memory()), "source"), ((memory(spark), None, Memory()), "cascade"), ((memory(spark), ALL, None), "sink"), ((memory(spark), ALL, Memory(), None, -1), "negative")):
        with pytest.raises(ValueError, match=said):
            Engine(*args)


def test_folders_and_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.txt").write_text("apple\nberry\n\n")
    (source / "2.txt").write_text("cherry\n")
    cascade = Cascade([RulesStage([Rule("a", contains=["a"]), Rule("rr", any=[Matcher(regex="rr")])])])
    out, review = Memory(), JsonLinesFolder(f"file://{tmp_path}/review", mode="append")
    query, stats = run_stream(line_stream(spark, f"file://{source}", files_per_batch=1), cascade, out, f"file://{tmp_path}/progress", review)
    query.awaitTermination()
    assert str(stats) == "processed=4 classified=3 review=1 by_stage=map[rules:3]"
    assert sorted(bytes(r["data"]) for r in out.entries()) == [b"apple", b"berry", b"cherry"]
    assert spark.read.text(f"file://{tmp_path}/review").count() == 1


LOGS = [
    (b"2024-01-02T03:04:05Z ERROR db=main", {"timestamp": "2024-01-02T03:04:05Z", "level": "error", "db": "main"}),
    (b'level=warn msg="a \\"q\\" \\\\ \\n" k= =v x', {"level": "warn", "msg": 'a "q" \\ \\n', "k": ""}),
    (b"[INFO]: started", {"level": "info"}), (b"plain line", None), (b"", None), (b"a=1 a=2", {"a": "2"}), (b'm="open end', {"m": "open end"}),
    (b"2024-13-02T03:04:05Z info", None), (b"2024-01-02t03:04:05Z x", None), ("İNFO x".encode(), {"level": "info"}), (b"INFO level=debug", {"level": "debug"}),
]


@pytest.mark.parametrize(("line", "want"), LOGS)
def test_log_lines(line, want):
    assert logfields.parse_line(line) == want


def test_log_enrichment(spark):
    df = from_memory(spark, [{"id": "1", "kind": "text", "data": "info a=1 b=2", "fields": {"a": {"x": 1}}}, {"id": "2", "kind": "text", "data": "nothing"}, {"id": "3", "kind": "text", "data": "k=v"}])
    rows = logfields.with_log_fields(df).select("kind", F.to_json("fields").alias("f")).orderBy("id").collect()
    assert [(r["kind"], r["f"] and json.loads(r["f"])) for r in rows] == [("log", {"a": {"x": 1}, "b": "2", "level": "info"}), ("text", None), ("log", {"k": "v"})]


VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "hello", ",", "world", "cafe", chr(0x4E2D), "!"]


def test_wordpiece(spark):
    t = WordPiece.parse([x + "\r\n" for x in VOCAB])
    tokens = lambda text, **o: WordPiece.parse(VOCAB, **o).encode(text).tokens[1:-1]
    assert t.encode("unaffable").ids == [2, 4, 5, 6, 3]
    assert tokens("Hello, Caf" + chr(0xE9) + chr(0x4E2D) + "\x00!") == ["hello", ",", "cafe", chr(0x4E2D), "!"]
    assert tokens("hellox") == ["[UNK]"] and tokens("Hello", lowercase=False) == ["[UNK]"] and tokens("hello", max_chars_per_word=4) == ["[UNK]"]
    assert len(t.encode("").ids) == 2 and WordPiece.parse(VOCAB, max_len=3).encode("hello world").tokens == ["[CLS]", "hello", "[SEP]"]
    for vocab, options in (({}, {}), ({"a": 0}, {}), (dict.fromkeys(VOCAB, 0), {"max_len": 1}), (dict.fromkeys(VOCAB, 0), {"max_chars_per_word": 0})):
        with pytest.raises(ValueError, match="wordpiece: "):
            WordPiece(vocab, **options)
    df = spark.createDataFrame([("hello world",), (None,)], "t string")
    rows = encode_column(df, t, "t").collect()
    assert rows[0]["encoding"]["mask"] == [1, 1, 1, 1] and rows[0]["encoding"]["type_ids"] == [0] * 4 and rows[1]["encoding"] is None


def test_wordpiece_arrays_are_small_whatever_the_batch(spark):
    t = WordPiece.parse(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "##a", ",", "b"])
    texts = ["a" * 90 + " b," * 500, None, "", "\tb\n\ra\x0ba\u00a0b", *["a, b " * 400] * 3000, "b " * 300_000]
    made = list(t.encode_batches([pa.array(texts, pa.string()), pa.array([], pa.string())]))
    assert max(x.nbytes for x in made[:-1]) < 8e6 and len(made[-1]) == 1
    rows = [r for x in made[:2] for r in x.to_pylist()]
    assert rows == [x if x is None else vars(t.encode(x)) for x in texts[: len(rows)]] and sum(map(len, made)) == len(texts)
    assert rows[3]["tokens"] == ["[CLS]", "b", "a", "##a", "b", "[SEP]"] and made[-1][0]["ids"].as_py() == [2, *[7] * 300_000, 3]
    df = spark.range(700).select("id", F.expr("if(id % 7 = 3, null, repeat('a, b ', cast(id as int)))").alias("t")).coalesce(1)
    rows = encode_column(df, t, "t").select("id", F.size("encoding.tokens").alias("n"), F.array_distinct("encoding.ids").alias("ids")).collect()
    assert [r["n"] for r in rows] == [None if i % 7 == 3 else 2 + 3 * i for i in range(700)] and rows[-1]["ids"] == [2, 4, 6, 7, 3]
    assert encode_column(df.where("id < 0"), t, "t").count() == 0 and encode_column(df.where("id < 0"), t, "t").collect() == []


def test_wordpiece_workers_do_not_hold_the_encodings_of_a_batch(spark):
    import threading

    psutil = pytest.importorskip("psutil")

    def workers():
        found = {}
        for p in psutil.Process().children(recursive=True):
            with contextlib.suppress(psutil.Error):
                if "python" in p.name():
                    found[p.pid] = p.memory_info().rss / 2**20
        return found

    t = WordPiece.parse(["[UNK]", "[CLS]", "[SEP]", "a", "##b"])
    df = encode_column(spark.range(0, 5000, 1, 1).select(F.expr("repeat('ab ', 1000)").alias("t")), t, "t")
    before, most, done = workers(), {}, threading.Event()

    def watch():
        while not done.wait(0.05):
            for pid, mb in workers().items():
                most[pid] = max(most.get(pid, 0), mb)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        assert df.agg(F.sum(F.size("encoding.ids"))).head()[0] == 5000 * 2002
    finally:
        done.set()
        watcher.join()
    assert 0 < max(mb - before.get(pid, 0) for pid, mb in most.items()) < 250


@pytest.mark.parametrize("options", [{}, {"lowercase": False}, {"max_len": 5}, {"max_len": 2}, {"max_chars_per_word": 2}])
def test_wordpiece_of_odd_texts(options):
    vocab = ["[UNK]", "[CLS]", "[SEP]", "a", "##a", "aa", "##\u03c3", "\u03c3", "i", ".", "`", "\u4e2d", "A", "##bc"]
    odd = {
        "aaa.a": ["aa", "##a", ".", "a"], "\u4e2d\u4e2da": ["\u4e2d", "\u4e2d", "a"], "a\u200ba\x00a": ["aa", "##a"], "a\u2028a": ["a", "a"], "\u1fef": ["`"],
        "abc abd": ["a", "##bc", "[UNK]"], "A\u0301": ["a"], "\u0130": ["i"], "\u03a3\u03a3": ["\u03c3", "##\u03c3"], "": [], " \n": [], "a" * 300 + " a" * 200_000: ["[UNK]"] + ["a"] * 200_000,
    }
    t = WordPiece.parse(vocab, **options)
    for text, want in odd.items():
        found = t.encode(text)
        assert len(found.ids) == len(found.mask) == len(found.tokens) and [vocab[i] for i in found.ids] == found.tokens
        if not options:
            assert found.tokens[1:-1] == want
        if "max_len" in options:
            assert found.tokens[1:-1] == want[: options["max_len"] - 2]
    if "lowercase" in options:
        assert t.encode("A a").tokens[1:-1] == ["A", "a"] and t.encode("\u00c1").tokens[1:-1] == ["[UNK]"]
    if "max_chars_per_word" in options:
        assert t.encode("aaa aa.").tokens[1:-1] == ["[UNK]", "aa", "."]


def test_wordpiece_matches_no_words_far_behind_the_cut():
    t = WordPiece.parse(["[UNK]", "[CLS]", "[SEP]", "a", "##a"], max_len=16)
    assert t.encode(" ".join("a" * (i % 30 + 1) + f" x{i}" for i in range(10_000))).tokens == "[CLS] a [UNK] a ##a [UNK] a ##a ##a [UNK] a ##a ##a ##a [UNK] [SEP]".split()
    assert len(t.cache) < 100


def test_wordpiece_takes_no_memory_for_words_far_behind_the_cut():
    import tracemalloc

    t = WordPiece.parse(["[UNK]", "[CLS]", "[SEP]", "a", "##b", ","], max_len=16)
    text = "ab,\n\tab " * 200_000
    tracemalloc.start()
    try:
        found = t.encode(text).tokens
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found == ["[CLS]", *(["a", "##b", ",", "a", "##b"] * 3)[:14], "[SEP]"] and most < 3 * len(text)


def test_a_run_can_be_cancelled(spark):
    import threading
    import time

    def slow(rows):
        time.sleep(20)
        return [None] * len(rows)

    engine = Engine(memory(spark, "a"), Cascade([RowStage("slow", slow)]), Memory())
    timer = threading.Timer(4, engine.cancel)
    timer.start()
    began = time.time()
    with pytest.raises(Exception, match="(?i)cancel"):
        engine.run()
    timer.join()
    assert time.time() - began < 18
