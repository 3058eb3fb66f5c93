import io
import json
import urllib.error

from pyspark.sql import functions as F

from tidewrack.operators.completion import STAGES, HttpCompleter, LengthStub, Stage, complete, merged, results_of


def test_stage_with_a_stub(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 4)) for i in range(20)] + [(99, None)], "id int, t string")
    stage = Stage("letters", "{text}", "label string", ["label"], "a.label <> 'bad'")
    got = complete(rows, "id", F.col("t"), stage, lambda: LengthStub("label", ["zero", "bad", "two"]))
    by = {r.id: (r.a.label, r.is_valid) for r in got.collect()}
    assert by == {i: (["zero", "bad", "two"][(i % 4) % 3], (i % 4) % 3 != 1) for i in range(20)} | {99: ("zero", True)}


def test_known_results_are_not_asked_again(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, t string")
    stage = STAGES["paper_environment"]
    first = complete(rows.limit(1), "id", F.col("t"), stage, lambda: LengthStub("label", ["Lake"]))

    def refuse():
        class Never:
            def complete(self, prompt):
                assert prompt.endswith("bb"), "asked again"
                return '{"label": "Wetlands"}'

        return Never()

    got = complete(rows, "id", F.col("t"), stage, refuse, results_of(first))
    assert {r.id: r.a.label for r in got.collect()} == {1: "Lake", 2: "Wetlands"}


def test_long_texts_are_asked_about_in_chunks(spark):
    """Accessions beyond the first chunk are found, one in an overlap once; rows of one head differ; U1 keeps its head."""
    filler = "x" * 11_900
    rows = spark.createDataFrame([(1, f"ACC1 {filler} ACC2 {filler} ACC3"), (2, f"ACC1 {filler} ACC4"), (3, "none"), (4, None)], "id int, t string")

    def finder():
        import re

        class Finder:
            def complete(self, prompt):
                return json.dumps([{"accession": x, "items": []} for x in re.findall("ACC[0-9]", prompt)])

        return Finder()

    done = complete(rows, "id", F.col("t"), STAGES["section_extraction"], finder)
    got = sorted((r.id, r.a and r.a.accession, r.is_valid) for r in merged(done, "id").collect())
    assert [x for x in got if x[0] < 3] == [(1, "ACC1", True), (1, "ACC2", True), (1, "ACC3", True), (2, "ACC1", True), (2, "ACC4", True)]
    assert [x for x in got if x[0] >= 3] == [(3, None, False), (4, None, False)]
    again = complete(rows, "id", F.col("t"), STAGES["section_extraction"], lambda: None, results_of(done))
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect()))
    head = complete(rows, "id", F.col("t"), STAGES["paper_environment"], lambda: LengthStub("label", ["Lake"]))
    assert head.count() == 4


def test_every_stage_schema_parses(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, t string")
    for stage in list(STAGES.values())[:4]:
        assert complete(rows, "id", F.col("t"), stage, lambda: LengthStub("nothing", ["x"])).count() == 1


def test_http_client_continues_and_retries(monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)
    calls = []

    def send(request):
        calls.append(json.loads(request.data))
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 429, "slow down", {"Retry-After": "0"}, io.BytesIO())
        done = len(calls) > 2
        return {"choices": [{"message": {"content": "end" if done else "start "}, "finish_reason": "stop" if done else "length"}]}

    assert HttpCompleter("http://example.invalid", "m", send=send).complete("hi") == "start end"
    assert [c["max_tokens"] for c in calls] == [4096, 4096, 6144]


def test_http_client_gives_up_on_refused_content():
    def send(request):
        raise urllib.error.HTTPError("u", 403, "no", {}, io.BytesIO())

    assert HttpCompleter("http://example.invalid", "m", send=send).complete("hi") == ""
