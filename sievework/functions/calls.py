"""Small per-line helpers on masked code: calls, their arguments, receivers, loop bounds. Spark hands them lines or texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from sievework.functions.segment import masked_line, masked_text

_NAME = r"[A-Za-z_]\w*"
_CHAIN = re.compile(rf"{_NAME}(?:\s*\.\s*{_NAME}|\s*\([^()]*(?:\([^()]*\)[^()]*)*\))*")
_QUOTED = re.compile(r'"(?:[^"]|"")*(?:"|$)')
_LOOP = re.compile(rf"\s*for\s+(each\s+)?({_NAME})(.*)", re.I)
_NEXT = re.compile(rf"\s*next\b\s*({_NAME})?", re.I)
_SIGNATURE = re.compile(r"\s*(?:(?:private|protected|public|shared)\s+)*(?:sub|function)\s", re.I)


def _outside_quotes(text: str) -> str:
    """text with each quoted literal, a doubled quote included, as a run of underscores."""
    return _QUOTED.sub(lambda m: "_" * len(m[0]), text)


def call_span(line: str, start: int) -> tuple[int, int] | None:
    """Places of the brackets of the first call at or after start; None if there is none or it does not close on the line."""
    plain, depth = _outside_quotes(line), 0
    first = plain.find("(", start)
    for at in range(first, len(plain)) if first >= 0 else ():
        depth += (plain[at] == "(") - (plain[at] == ")")
        if not depth:
            return first, at
    return None


def arguments(text: str) -> list[str]:
    """The arguments of a call, cut at commas outside brackets and quotes, with their spaces."""
    plain, depth, cuts = _outside_quotes(text), 0, [-1]
    for at, c in enumerate(plain):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            cuts.append(at)
    return [text[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def can_receive(expression: str) -> bool:
    """Whether a method can be called on the expression: a name, or a chain of members, calls and indexes from one."""
    return bool(_CHAIN.fullmatch(masked_line(expression.strip())))


def calls_of(line: str, code: str, name: str) -> Iterator[tuple[str, int, list[str] | None]]:
    """(form, place, arguments) of each call of name on a line, method forms first, nested ones too; arguments None if it does not close."""
    for form, before in (("method", r"(?<=\.)"), ("global", r"(?<![\w.])")):
        for m in re.finditer(rf"{before}{re.escape(name)}\s*\(", code, re.I):
            span = call_span(code, m.start())
            yield form, m.start(), arguments(line[span[0] + 1 : span[1]]) if span else None


def to_methods(line: str, function: str, method: str, drop_empty: bool) -> tuple[str, int, int, int]:
    """The line with calls of a global function as methods of their first argument, and how many were converted, skipped for their receiver, or do not close.

    A converted call is looked at again from its start, as its receiver may hold another.
    """
    find, at, done, skipped, unclosed = re.compile(rf"(?<![\w.]){re.escape(function)}\s*\(", re.I), 0, 0, 0, 0
    while m := find.search(masked_line(line), at):
        span = call_span(masked_line(line), m.start())
        receiver, *rest = (x.strip() for x in arguments(line[span[0] + 1 : span[1]])) if span else ("",)
        if span and can_receive(receiver):
            brackets = f"({', '.join(rest)})" if rest or not drop_empty else ""
            line, at, done = f"{line[: m.start()]}{receiver}.{method}{brackets}{line[span[1] + 1 :]}", m.start(), done + 1
        else:
            at, skipped, unclosed = m.end(), skipped + bool(span), unclosed + (not span)
    return line, done, skipped, unclosed


def _is_name(text: str) -> bool:
    return text.isascii() and text.isidentifier()


def less_one(expression: str) -> str:
    """An index expression less one: a number as a number, a final + 1 dropped, a name minus 1, anything else in brackets."""
    e = expression.strip()
    if e.isascii() and e.isdigit():
        return str(int(e) - 1)
    before, _, last = (x.strip() for x in e.rpartition("+"))
    if before and last == "1":
        return before
    return f"{e} - 1" if _is_name(e) else f"({e}) - 1"


def to_zero_based(line: str, old: str, new: str) -> tuple[str, int, int, int, int]:
    """The line with calls of a one-based function or method as the zero-based method `new`, its start less one.

    Beside it how many were converted, skipped as their source is no name, are another function as they lack a start, or
    do not close. What was converted is looked at again, as its arguments may hold another call.
    """
    done = skipped = foreign = unclosed = 0
    for before, place in ((r"(?<=\.)", 0), (r"(?<![\w.])", 1)):
        find, at = re.compile(rf"{before}{re.escape(old)}\s*\(", re.I), 0
        while m := find.search(masked_line(line), at):
            span = call_span(masked_line(line), m.start())
            given = [x.strip() for x in arguments(line[span[0] + 1 : span[1]])] if span else []
            at = m.end()
            if not span:
                unclosed += 1
            elif len(given) <= place or not (place or given[0]):
                foreign += 1
            elif place and not re.fullmatch(rf"{_NAME}(?:\.{_NAME})*", given[0]):
                skipped += 1
            else:
                receiver = f"{given[0]}." if place else ""
                line = f"{line[: m.start()]}{receiver}{new}({', '.join([less_one(given[place]), *given[place + 1 :]])}){line[span[1] + 1 :]}"
                at, done = m.start(), done + 1
    return line, done, skipped, foreign, unclosed


def _bound(rest: str) -> str | None:
    """The least value of a loop's counter, as written behind its name: where it begins, or ends if it counts down; None if that cannot be read."""
    declared, equals, span = rest.partition("=")
    words, typed = span.split(), declared.split()
    low = [w.lower() for w in words]
    at = next((i for i, w in enumerate(low) if w in ("to", "downto")), 0)
    by = next((i for i, w in enumerate(low) if w == "step" and i > at + 1), len(words))
    step = "".join(words[by + 1 :])
    known = not typed or (len(typed) == 2 and typed[0].lower() == "as")
    if not (equals and known and 0 < at < by - 1) or by == len(words) - 1 or (step and not step.lstrip("+-").isdigit()):
        return None
    down = low[at] == "downto" or step.startswith("-")
    return " ".join(words[at + 1 : by] if down else words[:at])


def _name_and_offset(text: str) -> tuple[str, int] | None:
    """A name with a number added to it or taken from it; None for any other expression."""
    if _is_name(text):
        return text, 0
    for sign in "+-":
        name, _, number = (x.strip() for x in text.rpartition(sign))
        if _is_name(name) and number.isascii() and number.isdigit():
            return name, int(sign + number)
    return None


def _least(start: str, loops: list[tuple[bool, str, str | None]]) -> tuple[str, int | None]:
    """(label, least value) of the start argument of a call in open loops (each, counter, bound); no value if it cannot be told."""
    if start.isascii() and start.isdigit():
        return "LITERAL", int(start)
    parts = _name_and_offset(start)
    if parts is None:
        return "COMPLEX", None
    name, offset = parts
    innermost = next((x for x in reversed(loops) if x[1] == name.lower()), None)
    if innermost is None:
        return f"{name} (no loop)", None
    each, _, bound = innermost
    if each:
        return f"{name} (For Each)", None
    number = bound is not None and bound.removeprefix("-").isdigit()
    return f"{name}={'?' if bound is None else bound}", int(bound) + offset if number else None


def start_verdict(start: str, loops: list[tuple[bool, str, str | None]]) -> tuple[str, str]:
    """(label, verdict) of the start argument of a call in open loops: safe, risky if it may be below 1, review if that cannot be told."""
    label, least = _least(start.strip(), loops)
    return label, "review" if least is None else "safe" if least >= 1 else "risky"


def loop_starts(text: str, name: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, form, label, verdict) of the start argument of each call of name; loops end at the next signature."""
    loops: list[tuple[bool, str, str | None]] = []
    for no, (line, code) in enumerate(zip(text.split("\n"), masked_text(text).split("\n"), strict=True), 1):
        if not code.strip():
            continue
        if _SIGNATURE.match(code):
            loops.clear()
        if m := _LOOP.fullmatch(code):
            loops.append((bool(m[1]), m[2].lower(), None if m[1] else _bound(m[3])))
        elif m := _NEXT.match(code):
            place = max((i for i, x in enumerate(loops) if x[1] == m[1].lower()), default=0) if m[1] else len(loops) - 1
            del loops[max(place, 0) :]
        for form, _, given in calls_of(line, code, name):
            place = int(form == "global")
            if given and len(given) > place and given[place].strip():
                yield no, form, *start_verdict(given[place], loops)
