import io
import os

import pytest

from sluice.operators.sinks import JsonLines
from sluice.plans import config
from sluice.plans.cli import USAGE, Command, CommandError, identity

RULES = """
rules:
  - id: probe
    category: noise
    contains: ["/ping"]
  - category: money
    regex: ["invoice (paid|late)"]
  - id: login
    category: access
    any:
      - contains: denied
      - field: {path: event, exact: login}
  - category: slow
    all:
      - field: {path: http.ms, gte: 1000000}
"""
MOCK = "matchers:\n  - contains: [parcel]\n    category: goods\n    confidence: 0.8\ndefault: {category: other, confidence: 0.2}\n"
CONFIG = """
version: 1
input: {type: text}
stages:
  - {id: first, type: rules, path: rules.yml, gate: 1.0}
  - {id: model, type: mock, path: mock.yml, gate: 0.5}
sink: {type: jsonl, stream: stdout}
review: {type: jsonl, path: review.jsonl}
routes:
  noise: {type: drop}
  money: {type: jsonl, path: money.jsonl}
"""
LOG = "GET /ping\ninvoice late 7\naccess denied\nparcel 9 left\nnothing known\n"


@pytest.fixture
def here(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name, text in (("rules.yml", RULES), ("mock.yml", MOCK), ("cascade.yaml", CONFIG), ("log.txt", LOG)):
        (tmp_path / name).write_text(text)
    return tmp_path


def run(spark, *args, stdin=None):
    out, err = io.StringIO(), io.StringIO()
    Command(out, err, stdin, spark).main(args)
    return out.getvalue(), err.getvalue()


PROBE = '{"id":"%s:1","data":"GET /ping","category":"noise","confidence":1,"stage":"rules","reasons":[{"code":"probe","detail":"contains \\"/ping\\""}]}\n'


def test_rules_over_text(spark, here):
    out, err = run(spark, "run", "--rules", "rules.yml", "log.txt")
    lines = out.splitlines(keepends=True)
    assert lines[0] == PROBE % "log.txt"
    assert lines[1].endswith('"reasons":[{"code":"money","detail":"regex \\"invoice (paid|late)\\""}]}\n')
    assert '"detail":"any(contains \\"denied\\" or field event == \\"login\\")"' in lines[2] and len(lines) == 3
    assert err == (
        'level=WARN msg="records unclassified and dropped; logging the first, see stats for the total" record=log.txt:4\n'
        "processed=5 classified=3 review=2 by_stage=map[rules:3]\n"
    )
    again, _ = run(spark, "run", "--rules", "rules.yml", "--workers", "8", "--min-confidence", "0.9", "log.txt")
    assert again == out


def test_rules_over_json_lines(spark, here):
    (here / "e.jsonl").write_text('{"event":"login","a":1}\n\n{"http":{"ms":1000000}}\n{"event":"x"}\n')
    out, err = run(spark, "run", "--rules", "rules.yml", "--input", "jsonl", "e.jsonl")
    first, second = out.splitlines()
    assert first.startswith('{"id":"e.jsonl:1","kind":"json","data":"{\\"event\\":\\"login\\",\\"a\\":1}","fields":{"a":1,"event":"login"},"category":"access"')
    assert '"id":"e.jsonl:3"' in second and '"detail":"all(field http.ms >= 1e+06)"' in second
    assert "processed=3 classified=2 review=1" in err


def test_stdin_and_several_files(spark, here):
    out, err = run(spark, "run", "--rules", "rules.yml", stdin=io.BytesIO(b"GET /ping\n"))
    assert out == PROBE % "stdin" and "processed=1 classified=1 review=0 by_stage=map[rules:1]" in err
    out, err = run(spark, "run", "--rules", "rules.yml", "--review", "left.jsonl", "log.txt", "log.txt")
    assert len(out.splitlines()) == 6 and err == "processed=10 classified=6 review=4 by_stage=map[rules:6]\n"
    assert (here / "left.jsonl").read_text().splitlines()[1] == '{"id":"log.txt:5","data":"nothing known","category":"","confidence":0}'


def test_config_run(spark, here):
    out, err = run(spark, "run", "--config", "cascade.yaml", "log.txt")
    assert [x.split('"stage":"')[1].split('"')[0] for x in out.splitlines()] == ["first", "model"]
    assert '"confidence":0.8' in out and err == "processed=5 classified=4 review=1 by_stage=map[first:3 model:1]\n"
    assert '"id":"log.txt:2"' in (here / "money.jsonl").read_text() and '"id":"log.txt:5"' in (here / "review.jsonl").read_text()


def test_other_commands(spark, here):
    assert run(spark) == ("", USAGE)
    assert run(spark, "version")[0].startswith("sluice ")
    assert run(spark, "validate", "--config", "cascade.yaml")[0] == 'config structurally valid: 2 stage(s), input "text"\n'


def refused(spark, said, *args):
    with pytest.raises((CommandError, ValueError)) as e:
        run(spark, *args)
    assert said in str(e.value)


def test_refusals(spark, here):
    refused(spark, 'unknown command "x"', "x")
    refused(spark, "validate: --config is required", "validate")
    refused(spark, 'validate: unexpected argument "y"', "validate", "--config", "c", "y")
    refused(spark, "run: exactly one of --config or --rules is required", "run")
    refused(spark, "run: exactly one of --config or --rules is required", "run", "--config", "a", "--rules", "b")
    refused(spark, "run: --workers is declared in the config", "run", "--config", "cascade.yaml", "--workers", "2")
    refused(spark, 'run: --input must be text or jsonl, got "csv"', "run", "--rules", "rules.yml", "--input", "csv")
    refused(spark, "rules: open /nowhere.yml: no such file or directory", "run", "--rules", "/nowhere.yml")
    refused(spark, "text: open gone.txt: no such file or directory", "run", "--rules", "rules.yml", "gone.txt")
    refused(spark, "is also the rules file", "run", "--rules", "rules.yml", "--review", "./rules.yml")
    refused(spark, "is also an input file", "run", "--rules", "rules.yml", "--review", "log.txt", "log.txt")
    assert (here / "log.txt").read_text() == LOG


@pytest.mark.parametrize(("old", "new", "said"), [
    ("review.jsonl", "log.txt", "collides with an input"), ("review.jsonl", "mock.yml", "collides with an input"), ("review.jsonl", "cascade.yaml", "collides with an input"),
    ("review.jsonl", "money.jsonl", "more than once"), ("path: money.jsonl", "stream: stdout", "two sinks write to stdout"),
])
def test_output_collisions(spark, here, old, new, said):
    (here / "cascade.yaml").write_text(CONFIG.replace(old, new))
    refused(spark, said, "run", "--config", "cascade.yaml", "log.txt")


def test_same_path_by_links(here):
    os.link("log.txt", "hard")
    os.symlink("log.txt", "soft")
    same_path = lambda a, b: identity(a) == identity(b)
    assert same_path("log.txt", "hard") and same_path("./log.txt", "soft") and not same_path("log.txt", "mock.yml")
    os.symlink(".", "dir")
    assert same_path("dir/new", "new") and not same_path("dir/new", "newer")


BAD_CONFIGS = [
    ("", "config: empty document"), ("version: 1.5", 'config: version must be an integer, got "1.5"'), ("version: '1'", "config: "), ("version: 2", "config: unsupported version 2 (want 1)"),
    ("version: 1\nworkers: -1", "config: workers must not be negative, got -1"), ("version: 1\ninput: {type: csv}", 'config: input.type "csv" is not one of text, jsonl'),
    ("version: 1\ninput: {type: text}", "config: at least one stage is required"), (CONFIG.replace("id: first, ", ""), "config: stages[0]: id is required"),
    (CONFIG.replace("id: model", "id: first"), 'config: duplicate stage id "first"'), (CONFIG.replace("type: mock", "type: onnx"), 'config: stage "model": type "onnx" is not one of rules, schema, mock'),
    (CONFIG.replace("path: mock.yml, ", ""), 'config: stage "model": a mock stage needs a path'), (CONFIG.replace("gate: 0.5", "gate: 2"), 'config: stage "model": gate 2 is invalid: min confidence must be within [0, 1]'),
    (CONFIG.replace("stream: stdout", "stream: stderr"), 'config: sink: stream "stderr" is not one of stdout'), (CONFIG.replace("sink: {type: jsonl, stream: stdout}", "sink: {type: drop}"), "config: the default sink cannot be drop"),
    (CONFIG.replace("sink: {type: jsonl, stream: stdout}", "sink: {type: kafka}"), 'config: sink: type "kafka" is not one of jsonl, drop'), (CONFIG.replace("noise: {type: drop}", "noise: {type: drop, path: x}"), "config: route noise: a drop sink takes no path or stream"),
    (CONFIG.replace("noise: {type: drop}", '"": {type: drop}'), "config: a route category must not be empty"), (CONFIG.replace("review: {type: jsonl, path: review.jsonl}", "review: {type: jsonl}"), "config: review: a jsonl sink needs a path or a stream"),
    (CONFIG.replace("path: review.jsonl", "path: review.jsonl, stream: stdout"), "config: review: set either path or stream, not both"), (CONFIG + "extra: 1", "config: parse yaml: line 12: field extra not found"),
    (CONFIG + "---\n{}", "config: expected a single YAML document"), ("version: [", "config: parse yaml: "),
]


@pytest.mark.parametrize(("text", "said"), BAD_CONFIGS)
def test_bad_configs(text, said):
    with pytest.raises(ValueError) as e:
        config.parse_config(text)
    assert str(e.value).startswith(said)


def test_declarations():
    c = config.parse_config(CONFIG)
    assert (c.input_type, len(c.stages), c.stages[1].gate, c.routes["noise"].type, c.review.path) == ("text", 2, 0.5, "drop", "review.jsonl")
    assert len(config.parse_rules(RULES + "---\nmore").rules) == 4
    schema = config.parse_schema("category: bad\nfields:\n  - {path: a, required: true, type: number}\n  - path: b\n")
    assert [(f.path, f.required, f.type) for f in schema.fields] == [("a", True, "number"), ("b", False, "any")]
    for parse, text, said in (
        (config.parse_rules, "", "rules: at least one rule is required"), (config.parse_rules, "rule: []", "rules: parse yaml: line 1: field rule not found"),
        (config.parse_schema, "", "schema: category is required"), (config.parse_schema, "category: c\nfields: [{path: a, type: int}]", 'schema: unknown field type "int" (want any, string, number, or bool)'),
        (config.parse_schema, "category: c\n---\nx: 1", "schema: expected a single YAML document"), (config.parse_mock, "", "mock: at least one matcher or a default is required"),
        (config.parse_mock, "default: {category: a, confidence: 2}", 'mock: default: category "a" with confidence 2 is invalid'), (config.parse_mock, "default: {category: a, confidence: 1}\n---\n", "mock: expected a single YAML document"),
    ):
        with pytest.raises(ValueError) as e:
            parse(text)
        assert str(e.value).startswith(said)


def test_jsonl_sink_keeps_order(spark):
    from sluice.operators.cascade import Cascade
    from sluice.operators.mock import MockStage, Outcome
    from sluice.sources.tables import from_memory

    out = io.StringIO()
    df = from_memory(spark, [{"id": str(i), "data": "x"} for i in range(200)]).repartition(7)
    JsonLines(out).write(Cascade([MockStage(default=Outcome("c", 1.0))]).classify(df))
    assert [x.split('"')[3] for x in out.getvalue().splitlines()] == [str(i) for i in range(200)]


def test_numbers_as_written(spark, here):
    (here / "n.yml").write_text('rules:\n  - {category: ten, fields: [{path: n, exact: "1.10"}]}\n  - {category: big, fields: [{path: n, gte: 100}]}\n')
    (here / "n.jsonl").write_text('{"n":1.10}\n{"n":1e2}\n{"n":9007199254740993}\n{"n":1.1}\n')
    out, err = run(spark, "run", "--rules", "n.yml", "--input", "jsonl", "n.jsonl")
    assert [x.split('"fields":')[1].split(',"confidence"')[0] for x in out.splitlines()] == [
        '{"n":1.10},"category":"ten"', '{"n":1e2},"category":"big"', '{"n":9007199254740993},"category":"big"',
    ]
    (here / "n.yaml").write_text("version: 1\ninput: {type: jsonl}\nstages:\n  - {id: r, type: rules, path: n.yml}\nsink: {type: jsonl, stream: stdout}\n")
    again, _ = run(spark, "run", "--config", "n.yaml", "n.jsonl")
    assert again.replace('"stage":"r"', '"stage":"rules"') == out and "processed=4 classified=3 review=1" in err


def test_bad_bytes_one_mark_each(spark, here):
    (here / "all.yml").write_text('rules:\n  - {category: all, regex: ["x"]}\n')
    (here / "bad.txt").write_bytes(b"x\xe2\x82y\xffz\n")
    assert '"data":"x\\ufffd\\ufffdy\\ufffdz"' in run(spark, "run", "--rules", "all.yml", "bad.txt")[0]
