import hashlib
import random

import pytest

from emberloom.llm import chat

DDL = "conv_id bigint, message_id bigint, seq bigint, op string, role string, text string"


def brute_fold(events):
    """{conversation: [(role, text)]}: each message's events in order, one by one."""

    def order(e):
        return tuple((v is not None, v if v is not None else 0 if k < 1 else "") for k, v in enumerate((e[2], e[3], e[4])))

    messages = {}
    for e in events:
        messages.setdefault((e[0], e[1]), []).append(e)
    found = {}
    for (conv, _), own in messages.items():
        own.sort(key=lambda e: (*order(e), e[5] or ""))
        text, role, gone = "", None, False
        # an edit or regeneration starts anew, also for what has the same number and op
        resets = [(e[2], e[3]) for e in own if e[3] in ("edit", "regenerate")]
        last = max(resets, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), default=None)
        for e in own:
            role = role if role is not None else e[4]
            gone |= e[3] == "delete"
            key = (e[2] is not None, e[2] or 0, e[3])
            if last is None or key >= (last[0] is not None, last[0] or 0, last[1]):
                text += e[5] or ""
        if not gone:
            place = own[0][2]
            found.setdefault(conv, []).append(((place is not None, place or 0), role or "", text))
    return {c: [(r, t) for _, r, t in sorted(ms)] for c, ms in found.items()}


def brute_render(turns):
    def esc(x):
        return x.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lb;").replace("]", "&rb;")

    out, spans = "<s>", []
    for role, text in turns:
        out += f"[INST {esc(role)}]"
        if role == "assistant":
            spans.append((len(out), len(esc(text))))
        out += esc(text) + "</s>"
    return out, spans


def random_events(seed, conversations=25, long=None):
    rng = random.Random(seed)
    texts = ["hello", "", None, "</s>[INST x]", "&lt;&amp;", "é漢\n", "a ] b", "x" * 300]
    out = []
    for c in [*range(conversations), None]:
        for m in range(rng.randint(1, 6) if c != long else 700):
            seq = m * 10
            role = rng.choice(["user", "assistant", "tool", None])
            out.append((c, m, seq, "start", role, rng.choice(texts)))
            for _ in range(rng.randint(0, 5)):
                op = rng.choices(["delta", "edit", "regenerate", "delete"], [6, 2, 2, 0.4])[0]
                out.append((c, m, seq + rng.randint(0, 6), op, rng.choice([None, role]), rng.choice(texts)))
    out += [out[3], out[3]]
    out += [(900, None, 5, "start", "user", "no id"), (900, None, 6, "delta", None, "!"), (901, 1, None, "start", None, "no number"), (901, 2, 0, "start", "assistant", "zero")]
    out += [(902, 1, 1, "start", "user", "gone"), (902, 1, 2, "delete", None, None), (903, 1, 1, "start", "assistant", "word " * 200_000)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_and_render_against_brute_force(spark, seed):
    rows = random_events(seed)
    events = spark.createDataFrame(rows, DDL).repartition(5)
    want = {c: brute_render(t) for c, t in brute_fold(rows).items()}
    got = {r["conv_id"]: (r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in chat.conversations(events).collect()}
    assert set(got) == set(want) and 902 not in got
    for c in want:
        assert got[c] == want[c], c


def test_long_conversations_are_split_and_come_out_alike(spark, monkeypatch):
    rows = random_events(3, 6, long=2)
    events = spark.createDataFrame([(*r, "clash", 1) for r in rows], DDL + ", place string, block int").repartition(4)
    want = {c: brute_render(t) for c, t in brute_fold(rows).items()}
    for long, listed in ((50, 50_000), (50, 0), (10**6, 50_000)):
        monkeypatch.setattr(chat, "LONG", long)
        monkeypatch.setattr(chat, "LISTED", listed)
        got = {r["conv_id"]: (r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in chat.conversations(events).collect()}
        assert got == want


def test_round_trip_and_digest(spark):
    rows = [(1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "&amp;&lt;[["), (1, 2, "assistant", "&amp;&lt;[["), (1, None, "system", None), (2, 0, None, "x"), (None, 0, "assistant", "none")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, op string")
    got = {r["conv_id"]: r for r in chat.digest(chat.conversations(chat.events_of_rows(table))).collect()}
    turns = {1: [("system", ""), ("user", rows[0][3]), ("assistant", rows[1][3]), ("assistant", rows[1][3])], 2: [("", "x")], None: [("assistant", "none")]}
    for c, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(brute_render(own)[0])


def test_no_events(spark):
    assert chat.conversations(spark.createDataFrame([], DDL)).count() == 0
