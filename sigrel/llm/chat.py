"""Chat formatting by a small grammar, checked by reading the formatted text back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template. A turn is: OPEN role NEWLINE text CLOSE. ESCAPE before a control string makes it text.
OPEN, CLOSE, NEWLINE, ESCAPE = "### ", "</turn>", "\n", "\\"
#: Strings that the parser acts on, longest first; the escape is one of them.
CONTROLS = (CLOSE, OPEN, ESCAPE)
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ROLE_CONTROL = re.compile("|".join(map(re.escape, (*CONTROLS, NEWLINE))))
LEARNED = "assistant"


def escape(text: str, pattern: re.Pattern = _CONTROL) -> str:
    return pattern.sub(lambda m: ESCAPE + m[0], text)


class Parser:
    """Reads formatted text in pieces of any length and tells of roles and texts; deterministic, one pass.

    turn := OPEN role NEWLINE text CLOSE NEWLINE; in role and text an ESCAPE makes the control string (in a role
    also NEWLINE) after it plain. ``begin(role)``, ``content(piece)`` and ``end()`` are called in order. What is not
    in the grammar raises ValueError. No more than one control string is held back between pieces.
    """

    _TEXT = re.compile("|".join([re.escape(ESCAPE) + "(?:" + "|".join(map(re.escape, CONTROLS)) + ")", re.escape(CLOSE), re.escape(OPEN), re.escape(ESCAPE)]))
    _HELD = max(map(len, CONTROLS)) + len(ESCAPE)

    def __init__(self, begin, content, end):
        self.begin, self.content, self.end = begin, content, end
        self.rest, self.state = "", "between"

    def feed(self, piece: str, last: bool = False) -> None:
        s, i = self.rest + piece, 0
        while i < len(s):
            if self.state == "between":
                want = OPEN
                if len(s) - i < len(want) and not last:
                    break
                if not s.startswith(want, i):
                    raise ValueError("a turn must begin here")
                i, self.state, self.role = i + len(want), "role", []
            elif self.state == "role":
                m = re.compile(re.escape(ESCAPE) + "(?:" + "|".join(map(re.escape, (*CONTROLS, NEWLINE))) + ")|" + re.escape(NEWLINE)).search(s, i)
                if not m:
                    if last:
                        raise ValueError("a role doesn't end")
                    break  # roles are short: wait for the rest
                if m[0] == NEWLINE:
                    self.begin("".join(self.role) + s[i : m.start()])
                    self.state = "text"
                else:
                    self.role += [s[i : m.start()], m[0][len(ESCAPE) :]]
                i = m.end()
            elif self.state == "text":
                m = self._TEXT.search(s, i)
                safe = len(s) if last else len(s) - self._HELD
                if not m or (m.start() > safe):
                    if safe > i:
                        self.content(s[i:safe])
                        i = safe
                    break
                if m.start() > i:
                    self.content(s[i : m.start()])
                if m[0] == CLOSE:
                    self.end()
                    self.state = "after"
                elif m[0] in (OPEN, ESCAPE):
                    raise ValueError("a control string isn't escaped")
                else:
                    self.content(m[0][len(ESCAPE) :])
                i = m.end()
            else:
                if not s.startswith(NEWLINE, i):
                    raise ValueError("a turn must end with a new line")
                i, self.state = i + len(NEWLINE), "between"
        self.rest = s[i:]
        if last and (self.rest or self.state not in ("between",)):
            raise ValueError("the text ends inside a turn")


def parse(text: str) -> list[tuple[str, str]]:
    turns: list[list] = []
    p = Parser(lambda role: turns.append([role, []]), lambda x: turns[-1][1].append(x), lambda: None)
    p.feed(text, last=True)
    return [(role, "".join(x)) for role, x in turns]


def render(role: str, text: str) -> str:
    """One turn in the template. Plain content is tried first; what doesn't read back as it was gets escaped."""
    for r, t in ((role, text), (role, escape(text)), (escape(role, _ROLE_CONTROL), escape(text))):
        out = f"{OPEN}{r}{NEWLINE}{t}{CLOSE}{NEWLINE}"
        try:
            if parse(out) == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError("a turn can't be read back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """The columns of ``conversations`` (conv_id, turn, role, text) with ``formatted``, each turn checked by itself.

    The grammar joins turns without anything between, so a conversation's text is its turns' one after the other.
    Null roles and texts are empty ones; other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(formatted=[render(r, t) for r, t in zip(b["role"], b["text"])])

    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return c.mapInPandas(run, "conv_id long, turn long, role string, text string, formatted string")


def read_back(formatted: DataFrame) -> DataFrame:
    """Each conversation's digests, read from its formatted text by the parser as the turns stream by in order.

    A digest over a whole conversation has to see its bytes in order, so a conversation is read by one task, but
    piece by piece: rows are sorted by (conv_id, turn, role, text) by Spark, which spills, and the parser keeps one
    control string. Rows of a null conv_id are one conversation. Equal turn numbers are ordered by role and text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None

        class State:
            def __init__(self, conv_id):
                self.conv_id, self.n, self.chars, self.loss_chars, self.role = conv_id, 0, 0, 0, ""
                self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
                self.parser = Parser(self.begin, self.content, self.end)

            def begin(self, role):
                self.role, self.n = role, self.n + 1
                self.turns.update(role.encode("utf-8", "surrogatepass") + b"\n")

            def content(self, x):
                b = x.encode("utf-8", "surrogatepass")
                self.turns.update(b)
                if self.role == LEARNED:
                    self.loss.update(b)
                    self.loss_chars += len(x)

            def end(self):
                self.turns.update(b"\n")

            def row(self):
                self.parser.feed("", last=True)
                return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

        def frame(rows):
            return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

        for b in batches:
            done = []
            for conv_id, x in zip(b["conv_id"].astype("Int64"), b["formatted"]):
                key = None if conv_id is pd.NA else int(conv_id)
                if state is None or key != now:
                    if state:
                        done.append(state.row())
                    now, state = key, State(key)
                state.chars += len(x)
                state.parser.feed(x)
            yield frame(done)
        if state:
            yield frame([state.row()])

    dealt = formatted.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "formatted").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
