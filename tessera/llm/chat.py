"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns, then a template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import small_batches

#: Layouts: name, the nested field paths of a record, and how turns come from it. "each": a path of a list, a role
#: field and a text field; "turns": (role, fields joined by a blank line) in order, where a role can be "$field".
LAYOUTS = [
    {"name": "turn rows", "paths": ["role", "text"], "turns": [("$role", ["text"])], "roles": {}},  # as they are
    {"name": "turn rows, content", "paths": ["content", "role"], "turns": [("$role", ["content"])]},
    {"name": "messages", "paths": ["messages[].content", "messages[].role"], "each": ("messages", "role", "content")},
    {"name": "messages, text", "paths": ["messages[].role", "messages[].text"], "each": ("messages", "role", "text")},
    {"name": "from and value", "paths": ["conversations[].from", "conversations[].value"], "each": ("conversations", "from", "value")},
    {"name": "instruction and input", "paths": ["input", "instruction", "output"], "turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "instruction", "paths": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "prompt and completion", "paths": ["completion", "prompt"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt and response", "paths": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "system, prompt and response", "paths": ["prompt", "response", "system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question and answer", "paths": ["answer", "question"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"name": "nested prompt", "paths": ["prompt.text", "response.text"], "turns": [("user", ["prompt.text"]), ("assistant", ["response.text"])]},
]
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Strings that mark turns here or in common templates; none occurs unescaped inside a text.
OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = (OPEN, SEP, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def field_paths(x: object, at: str = "") -> set[str]:
    """The paths of a record's leaves; list items share a path. An empty object or list is a leaf."""
    if isinstance(x, dict) and x:
        return {p for k, v in x.items() for p in field_paths(v, f"{at}.{k}" if at else str(k))}
    if isinstance(x, list) and x:
        return {p for v in x for p in field_paths(v, f"{at}[]")}
    return {at}


def schema_fingerprint(paths: set[str] | list[str]) -> str:
    return xxhash.xxh64_hexdigest("\n".join(sorted(paths)))


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _at(x: object, path: str) -> object:
    for k in path.split("."):
        x = x.get(k) if isinstance(x, dict) else None
    return x


def registry(layouts: list[dict]) -> dict[str, dict]:
    """The layouts by the fingerprints of their paths."""
    return {schema_fingerprint(m["paths"]): m for m in layouts}


def turns_of(record: object, by: dict[str, dict], roles: dict[str, str]) -> tuple[str | None, list[tuple[str, str]]]:
    """The layout's name and the turns; None and no turns if no layout of the registry has the record's fingerprint."""
    m = by.get(schema_fingerprint(field_paths(record)))
    if m is None:
        return None, []
    roles = m.get("roles", roles)
    role = lambda r: roles.get(_text(r), _text(r))
    if "each" in m:
        items, r, t = m["each"]
        return m["name"], [(role(_at(x, r)), _text(_at(x, t))) for x in _at(record, items)]
    return m["name"], [(role(_at(record, r[1:]) if r[0] == "$" else r), "\n\n".join(s for f in fields if (s := _text(_at(record, f))) or len(fields) == 1)) for r, fields in m["turns"]]


def canonical_turns(df: DataFrame, id_col: str, order_col: str, record_col: str, layouts: list[dict] | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """(id, ord, seq, role, text, layout): the turns of JSON records, whatever their layout.

    The record's nested field paths are hashed and the hash selects the mapping. A conversation is the
    rows of one id by ord, each giving one turn or more (seq). A null text is empty. A record that is
    null, no JSON or of no known layout is kept as one row with null layout, role and text. Repeated rows
    are each kept, long texts whole, an empty table gives no rows, and other columns are not read.
    """
    by, roles = registry(layouts or LAYOUTS), ROLES if roles is None else roles
    names = ["id", "ord", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, o, r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    name, turns = turns_of(json.loads(r), by, roles) if r else (None, [])
                except ValueError:
                    name, turns = None, []
                out += [(i, o, k, a, t, name) for k, (a, t) in enumerate(turns)] or [(i, o, 0, None, None, name)]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "ord", "seq", "role", "text", "layout"])

    kinds = dict(df.dtypes)
    small_batches(df.sparkSession)
    chosen = df.select(*[F.col(c).alias(n) for c, n in zip((id_col, order_col, record_col), names, strict=True)])
    return chosen.mapInArrow(run, f"id {kinds[id_col]}, ord {kinds[order_col]}, seq int, role string, text string, layout string")


def escape(c: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string: reversible."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(s: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", s)


def format_turns(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns with segment, loss_start and loss_end: a conversation's text is its segments in order.

    The mask is in code points of the segment, end exclusive; both are null where nothing is learnt.
    One row a turn, so no conversation, however long, becomes one value. Unmapped rows have no segment.
    """
    role, text = (escape(F.coalesce(F.col(c), F.lit(""))) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), role, F.lit(SEP))
    masked = F.col("layout").isNotNull() & F.col("role").isin(*learn)
    return (
        turns.withColumn("segment", F.when(F.col("layout").isNotNull(), F.concat(head, text, F.lit(CLOSE))))
        .withColumn("loss_start", F.when(masked, F.length(head)))
        .withColumn("loss_end", F.when(masked, F.length(head) + F.length(text)))
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, parsed from its segments and mask: counts and digests of turns and learnt text.

    Rows of a conversation arrive in order (ord, seq, then role and text for ties) and only running digests are
    held, whatever its length. A digest of all turns is made in their order, so one conversation is one task's.
    """
    kind, pa_kind = dict(formatted.dtypes)["id"], to_arrow_type(formatted.schema["id"].dataType)
    pattern = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(SEP)}(.*?){re.escape(CLOSE)}", re.DOTALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa_kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, state = None, None

        def done() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for i, s, lo, hi in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if state is None or i != now:
                    out += [done()] if state else []
                    now, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                s = s or ""
                state[4] += len(s)
                for m in pattern.finditer(s):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if lo is not None:
                    t = unescape(s[lo:hi])
                    state[2] += len(t)
                    state[3].update(t.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 6, schema, strict=True)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), schema, strict=True)], schema=schema)

    ordered = formatted.repartition("id").sortWithinPartitions("id", "ord", "seq", "role", "text").select("id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
