import hashlib
import time

import pytest

from tidemark.llm.chat import EXTRA, MarkedTurns, format_chats, locate, located_by_prefixes, located_by_tails, op7_chat_format


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    convs = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    convs[-7] = [("user", EXTRA), ("assistant", EXTRA)]
    got = {r.conv_id: r for r in op7_chat_format(spark, d).collect()}
    assert set(got) == set(convs)
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        want = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(MarkedTurns()(turns)))
        r = got[k]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) == want


TURNS = [("user", " </turn> "), ("assistant", "\\### Assistant: x </turn>\n### User: y"), ("a:b\\", ""), ("", "A"), ("assistant", "AA"), ("user", "é😀\n\n"), ("assistant", "\\")]


def test_round_trip_and_spans():
    t = MarkedTurns()
    for turns in (TURNS, TURNS * 60):
        whole, spans, rewritten = locate(t, turns)
        assert t.parse(whole) == turns and not rewritten and whole == t(turns)
        assert [t.unescape(whole[c:d]) for _, _, c, d in spans] == [x for _, x in turns]
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == len(whole)
    with pytest.raises(ValueError):
        t.parse("### user: a")


def test_templates_that_rewrite_history():
    def last_only(turns):  # drops what earlier turns said
        return "".join(f"[{r}|{x if i == len(turns) - 1 else ''}]" for i, (r, x) in enumerate(turns))

    counted = lambda turns: f"{len(turns)};" + "".join(f"<{r}>{x}" for r, x in turns)
    for render in (last_only, counted):
        assert locate(render, [("u", "abc"), ("v", "def"), ("u", "g"), ("v", "h")])[2]
    once = lambda turns: ("long;" if len(turns) >= 300 else "short") + "".join(f"<{r}>{x}" for r, x in turns)
    assert locate(once, [("u", "ab")] * 320)[2] and not locate(once, [("u", "ab")] * 299)[2]
    first_special = lambda turns: "BOS" + "".join(f"<{r}>{x}" for r, x in turns)
    whole, spans, bad = locate(first_special, [("u", "ab"), ("v", "c"), ("u", ""), ("v", "dd"), ("u", "e")])
    assert not bad and [whole[c:d] for *_, c, d in spans] == ["ab", "c", "", "dd", "e"]


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (None, 1, "user", "x"), (2, 5, "assistant", "y" * 100_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in format_chats(frame).collect()}
    assert MarkedTurns().parse(got[1].formatted) == [("", ""), ("assistant", "b"), ("assistant", "b")]
    assert [s.loss for s in got[1].spans] == [False, True, True] and set(got) == {1, 2, None}
    assert format_chats(frame.where("conv_id = 99")).collect() == []


def plain_locate(render, turns):
    """Every prefix rendered, compared character by character."""
    out, rewritten, before = [], False, render([])
    for i, (role, _) in enumerate(turns):
        now, a, b, none = (render([*turns[:i], (role, x)]) for x in (turns[i][1], "A", "B", ""))
        start = next((k for k, (x, y) in enumerate(zip(before, now)) if x != y), min(len(before), len(now)))
        inner = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        rewritten |= start < len(before)
        out.append((start, len(now), inner, inner + len(now) - len(none)))
        before = now
    return before, out, rewritten


class Appending(MarkedTurns):
    """Counts renders; from ``turn`` on it may rewrite what it has put out, against its own promise."""

    def __init__(self, turn=None):
        self.turn, self.renders = turn, 0

    def __call__(self, turns):
        self.renders += 1
        return ("!" if self.turn is not None and len(turns) >= self.turn else "") + super().__call__(turns)


def test_tails_give_what_whole_prefixes_give():
    turns = TURNS * 7
    for n in (0, 1, 2, 3, len(turns)):
        assert locate(Appending(), turns[:n]) == plain_locate(MarkedTurns(), turns[:n])
    assert locate(lambda t: MarkedTurns()(t), turns) == plain_locate(MarkedTurns(), turns)
    for turn in range(2, len(turns) + 1):  # a broken promise is found, whatever turn breaks it
        got = locate(Appending(turn), turns)
        assert got[2] and got == plain_locate(Appending(turn), turns)


def test_long_conversations_are_linear():
    turns = [("user", "Say it again."), ("assistant", "Again and again.")] * 50_000
    render = Appending()
    began = time.time()
    whole, spans, rewritten = locate(render, turns)
    assert time.time() - began < 20 and not rewritten and render.renders < 25
    assert [whole[c:d] for *_, c, d in spans] == [x for _, x in turns]
    tail = Appending(99_999)
    assert located_by_tails(tail, turns) is None


def test_rewriting_that_is_taken_back_is_found(spark):
    class Wavering(MarkedTurns):  # rewrites what it has put out at one number of turns only, against its own promise
        def __init__(self, turn):
            self.turn = turn

        def __call__(self, turns):
            return ("!" if len(turns) == self.turn else "") + super().__call__(turns)

    frame = spark.createDataFrame([(1, k, *t) for k, t in enumerate(TURNS)], "conv_id long, turn long, role string, text string")
    for turn in (3, 5, 6):
        (row,) = format_chats(frame, Wavering(turn)).collect()
        whole, spans, rewritten = plain_locate(Wavering(turn), TURNS)
        assert row.rewritten and rewritten and row.formatted == whole
        assert [tuple(s)[1:5] for s in row.spans] == spans
    for turn in range(2, len(TURNS) + 1):
        assert located_by_prefixes(Wavering(turn), TURNS) == plain_locate(Wavering(turn), TURNS)


def test_template_keeps_nothing_of_other_conversations():
    t = MarkedTurns()
    plain = lambda turns: "".join(t.added([], turn) for turn in turns)
    for turns in (TURNS, TURNS[::-1], [], TURNS[:3] + TURNS[:1], TURNS * 3, TURNS[:2]):
        assert located_by_prefixes(t, turns) == plain_locate(plain, turns)
        for n in (len(turns), 1, 2, len(turns) - 1, 0):
            assert t(turns[:n]) == plain(turns[:n]) and t([*turns[:n], ("a", "b")]) == plain([*turns[:n], ("a", "b")])


def test_every_prefix_of_a_long_conversation():
    turns = [("user", "Say it again."), ("assistant", "Again and again.")] * 5_000
    render = Appending()
    began = time.time()
    whole, spans, rewritten = located_by_prefixes(render, turns)
    assert time.time() - began < 20 and not rewritten and render.renders == 1 + 4 * len(turns)
    assert [whole[c:d] for *_, c, d in spans] == [x for _, x in turns]
