"""Providers over a command line and HTTP, voices, and trials of models."""

import json
import sys
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import trials, voices
from quire.operators.narration import samples
from quire.operators.providers import ModelError, QuotaError, Result, check_ready, provider
from quire.operators.remote import Chat, Command, JsonAnswer, events, json_lines, register_chat, register_command


def test_commands():
    echo = Command((sys.executable, "-c", "import sys; print(sys.argv[1], sys.stdin.read())", "{system}/{model}"))
    assert echo("prompt", "sys", "m").text == "sys/m prompt\n"
    fail = lambda text, code=1: Command((sys.executable, "-c", f"import sys; sys.stderr.write({text!r}); sys.exit({code})"))
    with pytest.raises(QuotaError):
        fail("You hit your limit")("p", "s", None)
    for call in (fail("broken"), Command((sys.executable, "-c", "import time; time.sleep(9)"), timeout=0.3), Command(("no-such-program",))):
        with pytest.raises(ModelError) as e:
            call("p", "s", None)
        assert not isinstance(e.value, QuotaError)
    register_command("missing", "no-such-program")
    with pytest.raises(ModelError):
        check_ready("missing")
    assert json_lines('x\n{"a": 1}\n{bad\n{"b": 2}') == [{"a": 1}, {"b": 2}]


@pytest.fixture(scope="module")
def service():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            kind = body["messages"][1]["content"]
            code = {"paid": 402, "busy": 429, "bad": 500}.get(kind, 200)
            choice = {"message": {"content": f"{body['model']}: {kind}"}, "finish_reason": "length" if kind == "long" else "stop"}
            answer = {"choices": [] if kind == "none" else [choice], "usage": {"prompt_tokens": 3, "completion_tokens": 4, "cost": 0.5}}
            text = {"busy": b"Rate limit exceeded", "bad": b"oops", "junk": b"not json"}.get(kind, json.dumps(answer).encode())
            self.send_response(code)
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_chat_services(service, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k")
    call = Chat(service, "SOME_KEY", retries=0)
    found = call("hello", "s", "m")
    assert (found.text, found.usage) == ("m: hello", {"input_tokens": 3.0, "output_tokens": 4.0, "cost_usd": 0.5})
    for kind in ("paid", "busy"):
        with pytest.raises(QuotaError):
            call(kind, "s", "m")
    for kind in ("bad", "junk", "none", "long"):
        with pytest.raises(ModelError) as e:
            call(kind, "s", "m")
        assert not isinstance(e.value, QuotaError)
    register_chat("service", service, "NO_SUCH_KEY", light_model="small")
    assert provider("service").needs_model and provider("service").light_model == "small"
    with pytest.raises(ModelError):
        check_ready("service")


@pytest.fixture
def streaming():
    """Answers in parts. A prompt lists the statuses of the first calls, and then how the answer goes on."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            *codes, kind = body["messages"][1]["content"].split()
            code = int(codes[len(asked) - 1]) if len(asked) <= len(codes) else 200
            self.send_response(code)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            if code != 200:
                self.send_header("Retry-After", "0")
            self.end_headers()
            if code != 200:
                return self.wfile.write(b"not now")
            self.part({"choices": [{"delta": {"content": "ő"}}]}, b": still here\n\nevent: part\n")
            if kind == "silent":
                time.sleep(2)
            if kind == "broken":
                return None
            if kind == "error":
                return self.part({"error": {"message": "overloaded"}})
            self.part({"choices": [{"delta": {"content": "b\n"}, "finish_reason": None}]})
            self.part({"choices": [{"delta": {}, "finish_reason": "stop" if kind == "whole" else kind}]})
            self.part({"choices": [], "usage": {"prompt_tokens": 3, "completion_tokens": 2}})
            return self.wfile.write(b"data: [DONE]\n\n")

        def part(self, value, before=b""):
            self.wfile.write(before + b"data: " + json.dumps(value).encode() + b"\r\n\r\n")
            self.wfile.flush()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    server.handle_error = lambda *args: None  # who asked is gone
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_events():
    assert list(events([b": hello\n", b"\n", b"data: a\n", b"data:b\n", b"id: 1\n", b"\n", b"\r\n", b"data: [DONE]\r\n", b"\r\n", b"data: cut"])) == ["a\nb", "[DONE]"]


def test_streamed_answers(streaming):
    url, asked = streaming
    call = Chat(url, "SOME_KEY", timeout=0.5, retries=2, pause=0.01)
    found = call("whole", "s", "m")
    assert (found.text, found.usage) == ("őb\n", {"input_tokens": 3.0, "output_tokens": 2.0})
    assert asked[0]["stream"] and len(asked) == 1
    for prompt, calls in (("429 503 whole", 3), ("broken", 1), ("error", 1), ("length", 1), ("content_filter", 1), ("400 whole", 1), ("500 500 500 whole", 3)):
        asked.clear()
        if calls == 3 and prompt.startswith("429"):
            assert call(prompt, "s", "m").text == "őb\n"
        else:
            with pytest.raises(ModelError) as e:
                call(prompt, "s", "m")
            assert not isinstance(e.value, QuotaError)
        assert len(asked) == calls, prompt
    asked.clear()
    with pytest.raises(QuotaError):  # still limited after all tries
        call("429 429 429 whole", "s", "m")
    asked.clear()
    with pytest.raises(ModelError, match="timed out"):
        call("silent", "s", "m")
    assert len(asked) == 1


def test_services_out_of_reach_are_tried_again(monkeypatch):
    pauses = []
    monkeypatch.setattr("quire.operators.remote.time.sleep", pauses.append)
    with pytest.raises(ModelError):
        Chat("http://127.0.0.1:9/", "SOME_KEY", retries=3, pause=20)("p", "s", "m")
    assert pauses == [20, 40, 60]


class Scripted:
    """Hears half of a text that holds "hard" until its second retake; sound is the length of the text."""

    def __init__(self):
        self.asked = []

    def speak(self, texts, seed, most_frames):
        self.asked.append((tuple(texts), seed, most_frames))
        return [np.full(len(t), 0.5) for t in texts]

    def hear(self, sound):
        texts, seed, _ = self.asked[-1]
        text = next(t for t in texts if len(t) == len(sound))
        return text[: len(text) // 3] if "hopeless" in text or "hard" in text and seed % 10 < 2 else text


def test_takes():
    voice = Scripted()
    score, sound, heard = voices.best_of(voice, "a hard one", 0, voice.speak(["a hard one"], 0, 400)[0])
    assert (score, heard, len(sound)) == (1.0, "a hard one", 10) and [a[1] for a in voice.asked] == [0, 1, 2]
    voice = Scripted()
    assert voices.best_of(voice, "hopeless", 0, voice.speak(["hopeless"], 0, 400)[0])[0] < 0.85 and len(voice.asked) == 4
    assert voices.most_frames(["x" * 1000]) == 3000


def test_pieces_are_spoken_in_batches(spark):
    rows = [(f"k{i}", "t" * (i + 1), 0, i // 2, i % 2, 10 * i) for i in range(5)]
    pieces = spark.createDataFrame(rows, "piece_key string, text string, window long, batch long, place long, seed long")
    got = {r.piece_key: r for r in voices.spoken_by(Scripted, "scripted")(pieces).collect()}
    assert sorted(got) == ["k0", "k1", "k2", "k3", "k4"] and all(r.score == 1.0 for r in got.values())
    assert len(samples(bytes(got["k3"].data))) == 4


def test_trials(spark):
    specs = ["a:x", "b:y", "c"]
    assert trials.blind_letters(specs, "judge") == trials.blind_letters(specs, "judge") and sorted(trials.blind_letters(specs, "judge").values()) == sorted(specs)
    letters = {"A": "b:y"}
    assert "# Version A\n\nT" in trials.blind_prompt("S", {"b:y": "T"}, letters)
    runs = spark.createDataFrame([("a:x", True, 5, 2.0), ("b:y", True, 6, None), ("c", True, 7, 1.0)], "spec string, ok boolean, seconds int, cost double")
    scores = spark.createDataFrame([("a:x", "j1", 8, 6), ("a:x", "j2", 4, 2), ("c", "j1", 9, 9)], "spec string, judge string, style int, sense int")
    got = [tuple(r) for r in trials.results(runs, scores, ["style", "sense"], F.lit(500.0), ("c",)).collect()]
    assert got == [("c", "c", "", 9.0, 1, None, None, 7), ("a:x", "a", "x", 5.0, 2, 10.0, 300.0, 5), ("b:y", "b", "y", 0.0, 0, 0.0, 0.0, 6)]


def test_judges_see_letters_alone(spark):
    asked = []

    def call(prompt, system, model):
        asked.append(prompt)
        return Result('scores: {"A": {"style": 7, "sense": 3}, "B": {"style": "high", "sense": 2}}' if len(asked) > 1 else "no object")

    letters = trials.blind_letters(["p:one", "p:two", "q"], "ann")
    got = trials.judged_by("ann", "S", {"p:one": "first", "p:two": "second", "q": "third"}, ["style", "sense"], call)
    assert {spec: scores for spec, _, scores in got} == {letters["A"]: {"style": 7.0, "sense": 3.0}, letters["B"]: {"sense": 2.0}, letters["C"]: {}}
    assert len(asked) == 2 and not any(spec in asked[0] for spec in letters.values() if ":" in spec)
    books = spark.createDataFrame([("b", "S", {"p:one": "first", "q": "third"})], "book_id string, source string, translations map<string,string>")
    answers = lambda prompt, system, model: Result('{"A": {"style": 9, "sense": 9}, "B": {"style": 1, "sense": 1}}')
    rows = trials.judge(books, {"ann": (answers, None), "ben": (answers, "m")}, ["style", "sense"]).collect()
    assert sorted((r.judge, r.spec, r.style) for r in rows) == sorted((j, s, 9.0 if x == "A" else 1.0) for j in ("ann", "ben") for x, s in trials.blind_letters(["p:one", "q"], j).items())
    runs = spark.createDataFrame([("p:one", True, 5, 2.0), ("q", True, 6, None)], "spec string, ok boolean, seconds int, cost double")
    table = trials.results(runs, trials.judge(books, {"ann": (answers, None)}, ["style", "sense"]).drop("book_id"), ["style", "sense"], F.lit(500.0)).collect()
    assert [r.score for r in table] == [9.0, 1.0]


def test_voices_by_name(spark):
    assert voices.voice_loader("silent") is voices.Silent
    assert voices.voice_loader("quire.operators.voices:Silent") is voices.Silent
    for wrong in ("none", "no.such.module:x", "quire.operators.voices:Nobody"):
        with pytest.raises(ModelError):
            voices.voice_loader(wrong)
    rows = [(f"k{i}", f"text {i}", 0, 0, i, i) for i in range(3)]
    pieces = spark.createDataFrame(rows, "piece_key string, text string, window long, batch long, place long, seed long")
    assert sorted((r.text, r.heard, r.score) for r in voices.spoken_by(voices.Silent, "silent")(pieces).collect()) == [(f"text {i}", f"text {i}", 1.0) for i in range(3)]


def test_answers_in_json():
    read = JsonAnswer("answer.text", (("tokens", ("n.in", "n.cache")),))
    found = read('log\n{"n": {"in": 3}}\n{"answer": {"text": "hello"}, "n": {"in": 4, "cache": 5}}\n')
    assert (found.text, found.usage) == ("hello", {"tokens": 12.0})
    with pytest.raises(QuotaError):
        read("usage limit reached")
    with pytest.raises(ModelError):
        read("")
