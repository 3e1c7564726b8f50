"""Messages, replies, the model call, resuming and the streaming run."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpuslens import fixed_values as fv
from corpuslens import session
from corpuslens.functions import messages
from corpuslens.operators import classify, evidence
from corpuslens.operators.classify import Endpoint
from corpuslens.plans import retrieval
from corpuslens.sources import readers
from corpuslens.streaming import answers as streaming

# Stubs of this module travel to the workers with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLIES = {
    '{"value": true}': True, '{"value": false}': False, ' {"value":false}\n': False, "true": None, '{"value": "true"}': None,
    "{}": None, '{"value": true, "explanation": "..."}': None, '[{"value": true}]': None, '{"value": null}': None,
    '{"value": true, "value": true}': None, '{"value": 1}': None, '{"Value": true}': None, "": None, '{"value": true': None, '{"value": {"value": true}}': None,
}


def test_reply_rule(spark):
    df = spark.createDataFrame(list(enumerate(REPLIES)), "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(messages.parse_response(F.col("s"))).collect()]
    assert got == list(REPLIES.values())
    for text, value in REPLIES.items():
        if value is None:
            with pytest.raises(ValueError):
                classify.strict_boolean(text)
        else:
            assert classify.strict_boolean(text) is value


def test_prompts_and_messages(spark):
    q = "  Is {surgery} the only treatment for bladder cancer? \n"
    df = spark.createDataFrame([("1", q), ("2", " ")], "question_id string, question string")
    rows = {(r["question_id"], r["prompt"]): r["message"] for r in evidence.messages_for(df, fv.PROMPTS).collect()}
    assert len(rows) == 6 and rows["2", "basic"] is None
    for p in fv.PROMPTS:
        assert q.strip() in rows["1", p] and "false medical assumption" in rows["1", p]
        assert "NCI PDQ" not in rows["1", p]
    found = spark.createDataFrame([("1", "E1")], "question_id string, evidence string")
    full = evidence.messages_for(df.where("question_id = '1'"), ["basic"], found).first()["message"]
    assert full.endswith(f"{q.strip()}\n\n{fv.EVIDENCE_HEADING}\nE1") and fv.EVIDENCE_RULE in full
    with pytest.raises(ValueError, match="basic, oncology_expert, patient_education"):
        evidence.messages_for(df, ["other"])


def test_endpoint_settings(monkeypatch):
    for name in ("LLM_BASE_URL", "LLM_MODEL", "LLM_API_KEY", "OPENAI_API_KEY", "LLM_TIMEOUT_SECONDS"):
        monkeypatch.delenv(name, raising=False)
    found = Endpoint.from_environment()
    assert (found.base_url, found.model, found.api_key, found.timeout_seconds) == (fv.DEFAULT_ENDPOINT, fv.DEFAULT_MODEL, "", 120.0)
    monkeypatch.setenv("OPENAI_API_KEY", "a")
    assert Endpoint.from_environment().api_key == "a"
    monkeypatch.setenv("LLM_API_KEY", "b")
    monkeypatch.setenv("LLM_BASE_URL", "https://example.test/v1")
    monkeypatch.setenv("LLM_TIMEOUT_SECONDS", "45")
    monkeypatch.setenv("LLM_MODEL", fv.DEFAULT_MODEL)
    pinned = Endpoint.from_environment(fv.SECOND_MODEL)
    assert pinned == Endpoint("https://example.test/v1", fv.SECOND_MODEL, "b", 45.0)
    for bad in (Endpoint(base_url=" "), Endpoint(model="")):
        with pytest.raises(ValueError):
            bad.check()
    with pytest.raises(ValueError):
        Endpoint().check(batch=True)
    with pytest.raises(ValueError):
        Endpoint(api_key="k").check(expected_model=fv.SECOND_MODEL)


def test_request_and_reply_shapes():
    sent = []

    def transport(*call):
        sent.append(call)
        return {"choices": [{"message": {"content": '{"value": true}'}}]}

    assert classify.ask(Endpoint("https://example.test/v1/", "m", "key", 9.0), "hello", transport) == '{"value": true}'
    address, body, headers, timeout = sent[0]
    assert address == "https://example.test/v1/chat/completions" and timeout == 9.0
    assert headers["Authorization"] == "Bearer key"
    assert body["messages"] == [{"role": "user", "content": "hello"}]
    assert (body["max_completion_tokens"], body["reasoning_effort"], body["temperature"]) == (32, "none", 0)
    assert body["response_format"]["json_schema"]["strict"] is True and "max_tokens" not in body
    for reply, words in (
        ({"choices": [{"message": {"content": None, "refusal": "Cannot classify."}}]}, "refused.*Cannot classify"),
        ({"choices": []}, "shape"), ({}, "shape"), ({"choices": [{"message": {"content": 5}}]}, "no text"),
    ):
        with pytest.raises(RuntimeError, match=words):
            classify.reply_text(reply)


def test_retry_waits_then_gives_up():
    waits, calls = [], []

    def failing(*call):
        calls.append(call)
        raise OSError("down")

    assert classify.ask_with_retry(Endpoint(), "m", failing, 3, waits.append) == (None, "OSError: down")
    assert classify.ask_with_retry(Endpoint(), None, failing, 3, waits.append) == (None, "ValueError: the question is blank")
    assert len(calls) == 3 and waits == [1, 2]


def even_length(address, body, headers, timeout):
    text = body["messages"][0]["content"]
    if "broken" in text:
        raise OSError("down")
    return {"choices": [{"message": {"content": json.dumps({"value": len(text) % 2 == 0})}}]}


def no_wait(seconds):
    pass


def questions(spark, n=9):
    return spark.createDataFrame(
        [(str(i), "broken" if i == 4 else "q" * (i + 1)) for i in range(n)], "question_id string, question string"
    )


def test_one_failure_does_not_stop_the_rest_and_stays_pending(spark, tmp_path):
    path = str(tmp_path / "run")
    options = dict(transport=even_length, sleep=no_wait, tasks=3)
    answered = retrieval.answer(questions(spark), ["basic"], Endpoint(), **options).collect()
    assert len(answered) == 9
    assert [(r["question_id"], r["answer"], r["error"]) for r in answered if r["error"]] == [("4", None, "OSError: down")]
    left = retrieval.resume(questions(spark), ["basic", "oncology_expert"], Endpoint(), path, **options)
    assert sorted((r["question_id"], r["prompt"]) for r in left.collect()) == [("4", "basic"), ("4", "oncology_expert")]
    saved = retrieval.saved_answers(spark, path)
    assert saved.count() == 16

    def repaired(address, body, headers, timeout):
        return {"choices": [{"message": {"content": '{"value": true}'}}]}

    again = retrieval.resume(questions(spark), ["basic", "oncology_expert"], Endpoint(), path, transport=repaired)
    assert again.isEmpty()
    saved = retrieval.saved_answers(spark, path)
    assert saved.count() == 18 and saved.select("question_id", "prompt").distinct().count() == 18
    # A run folder is a valid answer file for the evaluation.
    assert readers.read_answers(spark, f"{path}/prompt=basic").count() == 9


def test_blank_question_has_a_reason(spark):
    df = spark.createDataFrame([("1", "q"), ("2", "  "), ("3", None)], "question_id string, question string")
    rows = retrieval.answer(df, ["basic"], Endpoint(), transport=even_length).collect()
    assert {r["question_id"]: r["error"] for r in rows} == {"1": None} | dict.fromkeys("23", "ValueError: the question is blank")


def test_stopped_run_keeps_its_blocks(spark, tmp_path):
    """The second block's job breaks off; the first one's answers are there, and only the rest is asked again."""
    path, asked = str(tmp_path / "run"), []
    rows = retrieval.to_ask(questions(spark, 40).where("question <> 'broken'"), ["basic"])
    real = retrieval.append_answers

    def stops(answers, where):
        if asked:
            raise KeyboardInterrupt
        asked.append(1)
        real(answers, where)

    retrieval.append_answers = stops
    try:
        with pytest.raises(KeyboardInterrupt):
            retrieval.answer_in_blocks(rows, Endpoint(), path, 10, transport=even_length)
    finally:
        retrieval.append_answers = real
    saved = {r["question_id"] for r in retrieval.saved_answers(spark, path).collect()}
    assert 0 < len(saved) < 39
    left = retrieval.resume(questions(spark, 40), ["basic"], Endpoint(), path, block_rows=10, transport=even_length, sleep=no_wait)
    assert [r["question_id"] for r in left.collect()] == ["4"]
    assert retrieval.saved_answers(spark, path).count() == 39


def test_buckets_have_a_bound(spark):
    assert session.bucket_count(spark, 0) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.bucket_count(spark, 300 * session.BUCKET_BYTES) == 300
    assert session.bucket_count(spark, 10**6 * session.BUCKET_BYTES) == 100_000
    stored = session.store_bucketed(spark.range(5), "five", "id")
    name = session._TABLES[id(stored)]
    assert spark.catalog.tableExists(name)
    session.drop_bucketed(stored)
    assert not spark.catalog.tableExists(name)


def test_streaming_run_answers_each_question_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(name, ids):
        lines = [json.dumps({"question_id": i, "question": "q" * int(i)}) for i in ids]
        (source / name).write_text("\n".join(lines))

    def run(checkpoint="cp"):
        streaming.answer_stream(
            streaming.read_question_stream(spark, str(source)), ["basic"], Endpoint(), out, str(tmp_path / checkpoint),
            transport=even_length, sleep=no_wait,
        ).awaitTermination()
        return sorted(r["question_id"] for r in retrieval.saved_answers(spark, out).collect())

    arrive("a.json", ["1", "2", "2"])
    assert run() == ["1", "2"]
    arrive("b.json", ["2", "3"])
    assert run() == ["1", "2", "3"]
    assert run() == ["1", "2", "3"]
    assert run("lost-checkpoint") == ["1", "2", "3"]


def test_single_question_with_evidence(spark):
    from corpuslens.operators import bm25
    from test_bm25 import make_chunks

    index = bm25.build_index(make_chunks(spark, ["alpha beta", "gamma", "delta alpha"]))
    value, records = retrieval.classify_question(spark, " alpha? ", "basic", Endpoint(), index, transport=even_length)
    assert isinstance(value, bool) and [r["rank"] for r in records] == [1, 2]
    with pytest.raises(ValueError):
        retrieval.classify_question(spark, "  ", "basic", Endpoint(), index)
    with pytest.raises(ValueError):
        retrieval.classify_question(spark, "x", "other", Endpoint(), index)
    assert retrieval.classify_question(spark, "zzz", "basic", Endpoint(), index, transport=even_length)[1] == []
