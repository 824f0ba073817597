from quire.llm import chat


def render(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def brute(c, r):
    c, r = [(a or "", b or "") for a, b in c or []], [(a or "", b or "") for a, b in r or []]
    n = 0
    while n < min(len(c), len(r)) and c[n] == r[n]:
        n += 1

    def mask(turns):
        out, at = [], 0
        for role, text in turns:
            head, size = len(f"<|{role}|>\n"), len(text) + len("<|end|>\n")
            if role == "assistant":
                out.append((at + head, at + head + size))
            at += head + size
        return out

    return (n, render(c[:n]), render(c[n:]), render(r[n:]), mask(c[n:]), mask(r[n:]))


def test_formats_match_brute_force(spark):
    u, a, s = "user", "assistant", "system"
    pairs = [
        ([(s, "be"), (u, "hi"), (a, "yes é")], [(s, "be"), (u, "hi"), (a, "no"), (u, "x"), (a, "y")]),
        ([(u, "hi")], [(u, "hi")]),
        ([(u, "hi")], [(u, "hi"), (a, "more")]),
        ([(u, "a"), (a, "b")], [(a, "b"), (u, "a")]),
        ([], [(u, "a")]),
        (None, [(a, "b")]),
        (None, None),
        ([(None, None), (a, None)], [("", ""), (a, "z")]),
        ([(u, "w " * 50000), (a, "q")], [(u, "w " * 50000), (a, "r")]),
        ([(u, str(i)) for i in range(400)] + [(a, "1")], [(u, str(i)) for i in range(400)] + [(a, "2")]),
    ]
    pairs.append(pairs[0])
    df = spark.createDataFrame([(i, c, r, "z") for i, (c, r) in enumerate(pairs)], f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string")
    out = chat.format_preferences(df)
    for r in out.collect():
        assert (r.n_common, r.prompt, r.chosen_text, r.rejected_text, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask]) == brute(*pairs[r.pair_id]), r.pair_id
        assert all(r.chosen_text[x.start : x.end].endswith("<|end|>\n") for x in r.chosen_mask)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_pairs_from_turns(spark):
    rows = [(2, 1, "assistant", "two"), (2, 0, "user", "q2"), (3, 0, "user", "q3"), (3, 1, "assistant", "three"), (3, 1, "assistant", "three"), (3, 2, "user", "bye"), (4, 0, "user", "alone"), (5, 0, "assistant", "five"), (None, 0, "user", "x"), (8, None, "assistant", None), (9, 0, None, "n"), (9, 1, "assistant", "nine")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, last int")
    got = {r.pair_id: r for r in chat.paired(turns).collect()}
    assert sorted(got) == [2, 3, 8, 9]
    assert [tuple(x) for x in got[3].chosen] == [("user", "q3"), ("assistant", "three"), ("user", "bye")]
    assert [tuple(x) for x in got[3].rejected] == [("user", "q3"), ("assistant", "two"), ("user", "bye")]
    assert got[9].rejected[1].text == "" and got[9].chosen[0].role == ""
    assert chat.paired(turns.limit(0)).count() == 0
    digest = {r.pair_id: r for r in chat.preference_digest(chat.format_preferences(chat.paired(turns))).collect()}
    assert digest[2].n_common == 1 and digest[2].prompt == "<|user|>\nq2<|end|>\n" and digest[2].chosen_mask == "14-25"
