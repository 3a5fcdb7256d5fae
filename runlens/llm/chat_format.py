"""Chat formatting: typed content parts flattened into text, turns joined by a template, and read back.

A part is one of ``text``, ``image``, ``audio`` and ``document``. Flattening visits the parts of a
turn in order: text is escaped, every other part becomes a placeholder, and an attachment row notes
its kind, reference and the tokens the placeholder will expand to.

Escaping is reversible. Backslashes are doubled, then each control string gets one backslash after its
first character. A single backslash after such a character can only come from there, so it is taken
out first and the pairs are halved last.

Defined cases: null text, null role and a null list of parts count as empty. Rows with equal turn
are ordered by role, then text, nulls first; repeated rows are repeated turns. A null turn comes
first. Rows without conv_id form one conversation with a null id. An unknown part type is kept
as an ``other`` attachment of 0 tokens. An empty table gives an empty result; further columns of the
input are not read.

One conversation becomes one output value, so it has to fit into a row. Turns are escaped and flattened
where they are read, sorted in chunks of ``CHUNK_TURNS`` turn numbers, and only then put together.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
CHUNK_TURNS = 256


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of turns, what must not appear inside texts, and the tokens attachments expand to."""

    begin: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>\n"
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
    trained_roles: tuple[str, ...] = ("assistant",)
    image_tile: int = 512
    tokens_per_tile: int = 170
    tokens_per_image: int = 85
    tokens_per_second: float = 25.0
    tokens_per_page: int = 750
    first_characters: str = field(init=False, default="")

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")
        if not all(any(mark.startswith(c) for c in self.controls) for mark in (self.begin, self.middle, self.end)):
            raise ValueError("the template's own marks must start with a control string")
        object.__setattr__(self, "first_characters", "".join(sorted({c[0] for c in self.controls})))

    def escape(self, text: Column) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        single = "([" + "".join("\\" + c for c in self.first_characters) + r"])\\(?!\\)"
        return F.replace(F.regexp_replace(text, single, "$1"), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A list of parts that holds one text."""
    values = {"type": F.lit("text"), "text": text}
    names = [p.split(":") for p in PARTS[len("array<struct<"):-2].split(",")]
    return F.array(F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names]))


def flatten_parts(parts: Column, template: ChatTemplate) -> Column:
    """Visit the parts in order: struct(flat string, attachments array<struct<kind, ref, tokens>>)."""
    t = template

    def kind(p):
        return F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("other")

    def piece(p):
        return F.when(p["type"] == "text", t.escape(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), kind(p), F.lit("|>"))
        )

    def tiles(side):
        return F.greatest(F.ceil(F.coalesce(side, F.lit(0)) / t.image_tile), F.lit(0))

    def tokens(p):
        return (
            F.when(p["type"] == "image", t.tokens_per_image + tiles(p["width"]) * tiles(p["height"]) * t.tokens_per_tile)
            .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * t.tokens_per_second))
            .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * t.tokens_per_page)
            .otherwise(0)
            .cast("long")
        )

    whole = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    return F.struct(
        F.array_join(F.transform(whole, piece), "").alias("flat"),
        F.transform(
            F.filter(whole, lambda p: ~p["type"].eqNullSafe("text")),
            lambda p: F.struct(kind(p).alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")),
        ).alias("attachments"),
    )


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """``conv_id, turn, role, parts`` to one row per conversation.

    Returns conv_id, formatted, loss_spans (turn number from 0, start and length inside that turn's
    piece, start in the whole; code points, from 0), attachments (turn, kind, ref, tokens) in
    the order of their placeholders, and expanded_tokens, their sum.
    """
    t = template
    seen = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten_parts(F.col("parts"), t).alias("p")
    )
    turns = seen.select(
        "conv_id",
        F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"),
        F.struct(
            "turn",
            "role",
            F.col("p.flat").alias("flat"),
            F.concat(F.lit(t.begin), t.escape(F.col("role")), F.lit(t.middle), F.col("p.flat"), F.lit(t.end)).alias("piece"),
            F.col("p.attachments").alias("attachments"),
        ).alias("one"),
    )
    # null ids and null chunks are groups of their own
    chunks = turns.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "turns"))).alias("chunks"))
    ordered = whole.select("conv_id", F.flatten(F.col("chunks.turns")).alias("turns"))

    before_text = len(t.begin) + len(t.middle)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("turn"), F.array().cast(_SPANS).alias("spans"))

    def step(acc, x):
        lead = before_text + F.char_length(t.escape(x["role"]))
        span = F.struct(
            acc["turn"].alias("turn"),
            lead.cast("long").alias("start"),
            F.char_length(x["flat"]).cast("long").alias("length"),
            (acc["at"] + lead).cast("long").alias("start_in_chat"),
        )
        spans = F.when(x["role"].isin(*t.trained_roles), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(
            (acc["at"] + F.char_length(x["piece"])).cast("long").alias("at"), (acc["turn"] + 1).alias("turn"), spans.alias("spans")
        )

    noted = F.flatten(
        F.transform(
            F.col("turns"),
            lambda x, i: F.transform(
                x["attachments"],
                lambda a: F.struct(i.alias("turn"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
            ),
        )
    )
    done = ordered.select(
        "conv_id",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss_spans"),
        noted.alias("attachments"),
    )
    return done.withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    )


_SPANS = "array<struct<turn:int,start:bigint,length:bigint,start_in_chat:bigint>>"


def parse_chats(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Read turns and trained text back from ``formatted`` and ``loss_spans``.

    Adds turns, an array<struct<role, text>> with placeholders left in place, and loss_text.
    """
    t = template
    pieces = F.split("formatted", _quoted(t.begin))

    def turn(piece):
        role = F.substring_index(piece, t.middle, 1)
        # the end mark can not occur inside, so the text is what lies between the marks
        text = F.substring_index(F.substring_index(piece, t.middle, -1), t.end, 1)
        return F.struct(t.unescape(role).alias("role"), t.unescape(text).alias("text"))

    # the text before the first mark is empty
    cut = chats.withColumn("pieces", F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
    under_mask = F.transform(
        "loss_spans",
        lambda s: t.unescape(
            F.substring(
                F.element_at(F.col("pieces"), s["turn"] + 1),
                (s["start"] - len(t.begin) + 1).cast("int"),
                s["length"].cast("int"),
            )
        ),
    )
    return cut.withColumns({"turns": F.transform("pieces", turn), "loss_text": F.array_join(under_mask, "")}).drop("pieces")


def _quoted(mark: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in mark)
