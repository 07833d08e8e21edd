"""Model texts with a tool call, and what they must read as. ``{id}`` stands for the row's number."""

from __future__ import annotations

NO_CALL = ("discard", "(no_tool_call)", "agent emitted no parseable tool call; default discard", None, "no_tool_call")


def _bad(body: str) -> tuple:
    return ("discard", "(unparseable)", "agent tool-call body did not parse: " + body[:120], None, "unparseable")


def _unknown(name: str) -> tuple:
    return ("discard", name, f"agent called unknown tool '{name}'; default discard", None, "unknown_tool")


def _flag(reason: str) -> tuple:
    return ("flag", "flag_for_review", reason, None, "ok")


def _mark(body: str) -> str:
    return f"<|tool_call_start|>{body}<|tool_call_end|>"


_DEEP = "[" * 150 + "]" * 150
_TOO_DEEP = "[" * 10_000

#: Text, then action, tool, reason, direction and outcome.
CASES: list[tuple] = [
    (_mark('[downlink_now(reason="two clear pits {id}")]') + " done<|im_end|>", "downlink", "downlink_now", "two clear pits {id} — done", None, "ok"),
    (_mark('[request_neighbor_tile(direction="east", reason="plume")]'), "request_neighbor", "request_neighbor_tile", "[east] plume", "east", "ok"),
    ("I would discard tile {id}", *NO_CALL),
    (_mark("[discard(]"), *_bad("discard(")),
    (_mark('[launch(reason="{id}")]'), *_unknown("launch")),
    (_mark("flag_for_review(reason='no brackets {id}')"), *_flag("no brackets {id}")),
    (_mark('[flag_for_review(reason="tab\\there, \\x41, \\u00e9, \\N{BULLET}")]'), *_flag("tab\there, A, é, •")),
    (_mark('[flag_for_review(reason="a \\"quoted\\" word, (and) [brackets] {id}")]'), *_flag('a "quoted" word, (and) [brackets] {id}')),
    (_mark("[flag_for_review(reason='it\\'s' \" joined\" ' up')]"), *_flag("it's joined up")),
    (_mark('[flag_for_review(reason="""three\nlines\nof {id}""")]'), *_flag("three\nlines\nof {id}")),
    (_mark('[flag_for_review(reason="broken\nline")]'), *_bad('flag_for_review(reason="broken\nline")')),
    (_mark('[flag_for_review(reason=r"raw \\d+")]'), *_flag("raw \\d+")),
    (_mark('[flag_for_review(reason=f"made of {x}")]'), *_flag("None")),
    (_mark('[flag_for_review(reason=b"bytes")]'), *_flag("b'bytes'")),
    (_mark("[flag_for_review(reason=12)]"), *_flag("12")),
    (_mark("[flag_for_review(reason=-1.50)]"), *_flag("-1.5")),
    (_mark("[flag_for_review(reason=0x1F)]"), *_flag("31")),
    (_mark("[flag_for_review(reason=1_000)]"), *_flag("1000")),
    (_mark("[flag_for_review(reason=3+4j)]"), *_flag("(3+4j)")),
    (_mark("[flag_for_review(reason=True)]"), *_flag("True")),
    (_mark("[flag_for_review(reason=None)]"), *_flag("None")),
    (_mark("[flag_for_review(reason=why)]"), *_flag("None")),
    (_mark("[flag_for_review(reason=1 + 2)]"), *_flag("None")),
    (_mark("[flag_for_review(reason=len(x))]"), *_flag("None")),
    (_mark("[flag_for_review(reason=[1, 'two', (3,), {'k': [4]}])]"), *_flag("[1, 'two', (3,), {'k': [4]}]")),
    (_mark("[flag_for_review(boxes=" + _DEEP + ", reason='deep')]"), *_flag("deep")),
    (_mark("[flag_for_review(boxes=" + _TOO_DEEP + ", reason='deeper')]"), *_bad("flag_for_review(boxes=" + _TOO_DEEP)),
    (_mark("[flag_for_review({'a': 1}, *rest, **more, reason='mixed {id}')]"), *_flag("mixed {id}")),
    (_mark("[flag_for_review(x for x in y)]"), *_flag("(no reason given)")),
    (_mark("[flag_for_review(reason='a', reason='b')]"), *_bad("flag_for_review(reason='a', reason='b')")),
    (_mark("[flag_for_review(reason='a', 'b')]"), *_bad("flag_for_review(reason='a', 'b')")),
    (_mark("[flag_for_review(reason='  edges  ',)]"), *_flag("edges")),
    (_mark("[flag_for_review(\n  reason = 'spread',  # a remark\n)]"), *_flag("spread")),
    (_mark("[flag_for_review(reason='one'), discard(reason='two')]"), *_bad("flag_for_review(reason='one'), discard(reason='two')")),
    (_mark("[agent.flag_for_review(reason='x')]"), *_bad("agent.flag_for_review(reason='x')")),
    (_mark("[flag_for_review(reason='x')(1)]"), *_bad("flag_for_review(reason='x')(1)")),
    (_mark("[flag_for_review]"), *_bad("flag_for_review")),
    (_mark("[]"), *_bad("")),
    (_mark("[request_neighbor_tile(direction='north')]"), "request_neighbor", "request_neighbor_tile", "direction=north", "north", "ok"),
    (_mark("[request_neighbor_tile(direction='', reason='none {id}')]"), "request_neighbor", "request_neighbor_tile", "none {id}", None, "ok"),
    (_mark("[request_neighbor_tile(direction=['up', 2], reason='r')]"), "request_neighbor", "request_neighbor_tile", "[['up', 2]] r", "['up', 2]", "ok"),
    (_mark("[request_neighbor_tile(direction=0.0, reason='r')]"), "request_neighbor", "request_neighbor_tile", "r", None, "ok"),
    (_mark("[discard(reason='clear and empty')]") + " clear ", "discard", "discard", "clear and empty", None, "ok"),
    (_mark("[discard()]") + "\n nothing there <|im_end|> more", "discard", "discard", "nothing there", None, "ok"),
    ("so: " + _mark("[discard()]") + _mark("[downlink_now()]"), "discard", "discard", "<|tool_call_start|>[downlink_now()]<|tool_call_end|>", None, "ok"),
    ("<|tool_call_end|>" + _mark("[discard(reason='late')]"), "discard", "discard", "late — <|tool_call_start|>[discard(reason='late')]<|tool_call_end|>", None, "ok"),
    ("<|tool_call_start|>[discard(reason='open {id}')]", *NO_CALL),
    ("", *NO_CALL),
]

#: Rows whose reason is a million letters: one in so many.
LONG_EVERY = 4999
