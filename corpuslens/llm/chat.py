"""Chat formatting in budgeted windows.

Each turn is counted in tokens, and prefix sums over the conversation choose
windows that begin and end between turns: with T half of the budget left by the
history and the conversation's first system turn, a turn of at most T tokens goes to the
window of its start's multiple of T, so a window's own turns have 2 T tokens at most; a
longer turn is a window by itself and is never cut. A window begins with the system
turn (if that came before) and the turns before its own within the history
limit; both are repeats and masked, and beside a long turn they are taken only as far as
the budget has room for them. Loss falls on its own assistant turns only, so each assistant text is a target once.

No window has more tokens than the budget, but for one whose single own turn has. A system turn of more than half of
the budget without history is kept only where it fits. Turns begin and end with marks that the tokenizer
does not join, so the tokens of a window are the sum over its turns. Prefix sums run over blocks of turns and then over
the block totals; a very long conversation is spread over tasks.

The template is ``### Role: text</turn>`` and a line end. ``\\`` escapes what could be
mistaken for it, and is itself escaped; ``parse`` is the exact inverse of ``render``.

Defined results: null text and role count as empty; turns are ordered by turn, role
and text (nulls first), repeated rows are turns of their own; rows without a
conv_id form one conversation; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import text_of
from corpuslens.session import store

BUDGET = 1024
HISTORY = 256
TOKENIZER = "byte_bpe_50k.json"
SYSTEM, ASSISTANT = "system", "assistant"
# Turn numbers in a block of the first level of the prefix sums.
BLOCK = 256

_ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e"}
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":", "n": "\n"}
_NAMED = ("system", "user", "assistant")
_TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the text begins and ends."""
    name = role.capitalize() if role in _NAMED else "=" + escape(role).replace(":", "\\c").replace("\n", "\\n")
    head = f"### {name}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    out = []
    for m in _TURN.finditer(formatted):
        role = unescape(m[1][1:]) if m[1].startswith("=") else m[1].lower()
        out.append((role, unescape(m[2])))
    return out


def _token_counts(name: str):
    def count(roles: pd.Series, texts: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(name)
        turns = [render(r, t)[0] for r, t in zip(roles, texts)]
        return pd.Series([len(tokenizer.encode(t, add_special_tokens=False).ids) for t in turns], dtype="int64")

    return F.pandas_udf(count, "long")


_TOKENIZERS: dict = {}


def _tokenizer(name: str):
    if name not in _TOKENIZERS:
        import public_tokenizers
        from tokenizers import Tokenizer

        _TOKENIZERS[name] = Tokenizer.from_file(public_tokenizers.path(name))
        _TOKENIZERS[name].encode_special_tokens = True
    return _TOKENIZERS[name]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` with ``start`` (tokens before the turn) and ``place`` (turns before it)."""
    block = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    inside = turns.withColumn("in_start", F.coalesce(F.sum("tokens").over(block), F.lit(0))).withColumn(
        "in_place", F.count(F.lit(1)).over(block)
    )
    before = Window.partitionBy("block_conv").orderBy("block_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        turns.groupBy(F.col("conv_id").alias("block_conv"), F.col("block").alias("block_at"))
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"))
        .select("block_conv", "block_at", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("block_start"),
                F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("block_place"))
    )
    return inside.join(totals, _same("conv_id", "block_conv") & (F.col("block") == F.col("block_at"))).select(
        "conv_id", "role", "text", "tokens", (F.col("in_start") + F.col("block_start")).alias("start"),
        (F.col("in_place") + F.col("block_place")).alias("place"),
    )


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, window (rising in the conversation), text, loss (start, end in code points), repeated (turns), tokens."""
    half = (budget - history) // 2
    if not 0 <= history <= half:
        raise ValueError("history must be at most a third of the budget")
    turns = conversations.select(
        "conv_id", "turn", text_of(F.col("role")).alias("role"), text_of(F.col("text")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).alias("block"),
    )
    turns = store(turns.withColumn("tokens", _token_counts(tokenizer)("role", "text")), "counted-turns")
    placed = store(_placed(turns), "placed-turns")
    system = store(
        placed.where(F.col("role") == SYSTEM).groupBy(F.col("conv_id").alias("s_conv")).agg(
            F.min(F.struct("place", "start", "role", "text", "tokens")).alias("s")), "system-turns",
    )
    kept = F.coalesce(F.when(F.col("s.tokens") <= half, F.col("s.tokens")), F.lit(0))
    known = placed.join(system, _same("conv_id", "s_conv"), "left").withColumn("span", F.floor((F.lit(2 * half) - kept) / 2))
    # A turn longer than the span ends it: what starts in the same multiple comes before it.
    number = 2 * F.floor(F.col("start") / F.col("span")) + (F.col("tokens") > F.col("span")).cast("long")
    own = store(
        known.select("conv_id", "role", "text", "tokens", "start", "place", "span", F.col("s.place").alias("s_place"), number.alias("window")), "turns"
    )
    begun = own.groupBy(F.col("conv_id").alias("w_conv"), F.col("window").alias("w")).agg(
        F.min("start").alias("w_start"), F.min("place").alias("w_place"), F.sum("tokens").alias("w_tokens"))
    # The system turn comes first where it came before and fits; then history, as far as there is room.
    led_by = (F.col("s.place") < F.col("w_place")) & (F.col("w_tokens") + F.col("s.tokens") <= budget)
    room = F.lit(budget) - F.col("w_tokens") - F.when(F.col("led"), F.col("s.tokens")).otherwise(0)
    begun = store(
        begun.join(system, _same("w_conv", "s_conv"), "left").withColumn("led", F.coalesce(led_by, F.lit(False)))
        .select("w_conv", "w", "w_start", "led", F.least(F.lit(history), room).alias("reach")), "windows",
    )
    # A window that begins within the history limit after a turn is in one of these.
    first, last = F.floor(F.col("start") / F.col("span")), F.floor((F.col("start") + history) / F.col("span"))
    repeats = (
        own.drop("window").withColumn("window", F.explode(F.sequence(2 * first + 1, 2 * last + 1)))
        .join(begun, _same("conv_id", "w_conv") & (F.col("window") == F.col("w")))
        .where((F.col("start") < F.col("w_start")) & (F.col("start") >= F.col("w_start") - F.col("reach")))
        .where(~F.col("place").eqNullSafe(F.col("s_place")))
    )
    led = begun.where("led").join(system, _same("w_conv", "s_conv")).select(
        F.col("w_conv").alias("conv_id"), F.col("w").alias("window"), F.lit(0).alias("part"),
        F.col("s.place").alias("place"), "s.role", "s.text", "s.tokens",
    )
    columns = ["conv_id", "window", "part", "place", "role", "text", "tokens"]
    parts = (
        own.withColumn("part", F.lit(2)).select(columns)
        .unionByName(repeats.withColumn("part", F.lit(1)).select(columns)).unionByName(led)
    )
    formatted = F.pandas_udf(_formatted, "text string, loss array<array<int>>, repeated int")("turns.part", "turns.role", "turns.text")
    return (
        parts.groupBy("conv_id", "window")
        .agg(F.array_sort(F.collect_list(F.struct("part", "place", "role", "text"))).alias("turns"), F.sum("tokens").alias("tokens"))
        .select("conv_id", "window", formatted.alias("f"), "tokens").select("conv_id", "window", "f.*", "tokens")
    )


def _formatted(parts: pd.Series, roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
    out = []
    for part, role, text in zip(parts, roles, texts):
        written, loss, at = [], [], 0
        for p, r, t in zip(part, role, text):
            turn, a, b = render(r, t)
            written.append(turn)
            if p == 2 and r == ASSISTANT:
                loss.append([at + a, at + b])
            at += len(turn)
        out.append(("".join(written), loss, int((part < 2).sum())))
    return pd.DataFrame(out, columns=["text", "loss", "repeated"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations, from nothing but the output of :func:`windows`.

    The windows of a conversation stream through one task in order, as a SHA-256
    must; only the running digest is held.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for rows in batches:
            done = []
            for key, text, loss, repeated in rows.itertuples(index=False):
                if state is None or key != now:
                    if state:
                        done.append(_closed(now, state))
                    now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, plain in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{plain}\n".encode("utf-8", "surrogatepass"))
                for a, b in loss:
                    target = unescape(text[a:b])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield pd.DataFrame(done, columns=_DIGESTS)
        if state:
            yield pd.DataFrame([_closed(now, state)], columns=_DIGESTS)

    # A null id travels as the empty string.
    keyed = formatted.select(text_of(F.col("conv_id").cast("string")).alias("key"), "window", "text", "loss", "repeated")
    return (
        keyed.repartition("key").sortWithinPartitions("key", "window").drop("window")
        .mapInPandas(digest, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
        .select(F.expr(f"cast(nullif(key, '') as {kind})").alias("conv_id"), *_DIGESTS[1:])
    )


_DIGESTS = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _closed(key: str, state: list) -> tuple:
    return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
