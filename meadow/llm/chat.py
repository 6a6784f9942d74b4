"""Chat formatting: a small template language, compiled to Python closures.

`compile_template` reads a template into a syntax tree, folds what is constant and turns the tree into closures. The
language is a sandbox: text, `{{ expression }}`, `{% if %} {% elif %} {% else %} {% endif %}`, `{% for x in y %}
{% endfor %}`, `{% generation %} {% endgeneration %}`. Expressions know names, attributes (of mappings only), string and
number literals, `==`, `!=`, `and`, `or`, `not`, `+`, parentheses, and the filters of FILTERS. Nothing else can be
reached: no calls, no indexing, no Python attributes. What stands in a generation block is what a model learns from.

The stock template frames every turn; control strings inside a role or a text are escaped with a backslash, which
`unframed` undoes, so that the turns can be read back from the output whatever the texts say.

Rows of one conversation are brought together by a hash of its id and streamed in turn order (ties by role and text,
nulls first), so memory holds one conversation at a time. Null roles and texts count as empty; each
row with a null conversation id is a conversation of its own, so these spread over all tasks. Rows that repeat are turns of their own. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.llm.common import read, small_batches

OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|turn|>' + m.role | escape + '<|text|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|end|>' + '\\n' }}"
    "{% endfor %}"
)
FILTERS: dict[str, Callable[[str], str]] = {
    "escape": lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|"),
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


class TemplateError(ValueError):
    """The template can't be read."""


@dataclass(frozen=True)
class Node:
    """kind: text, name, get, not, and, or, eq, ne, add, filter, put, if, for, generation, all."""

    kind: str
    value: object = None
    parts: tuple = ()


_TAGS = re.compile(r"({{.*?}}|{%.*?%})", re.S)
_TOKENS = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|[.|+()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Reads one expression by precedence: or, and, not, comparison, plus, filter, value."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if (got := self.peek()) in wanted and got is not None:
            self.at += 1
            return got
        return None

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", parts=(node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", parts=(self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        if op := self.take("==", "!="):
            node = Node("eq" if op == "==" else "ne", parts=(node, self.added()))
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("add", parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.value()
        while self.take("|"):
            if (name := self.name()) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", name, (node,))
        return node

    def value(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("a value is missing")
        kind, text = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Node("text", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            self.at += 1
            return Node("text", text)
        node = Node("name", self.name())
        while self.take("."):
            node = Node("get", self.name(), (node,))
        return node


def parse(template: str) -> Node:
    """Syntax tree of a template."""
    pieces = [p for p in _TAGS.split(template) if p]
    at = 0

    def block(until: tuple[str, ...]) -> tuple[Node, str]:
        nonlocal at
        parts: list[Node] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                parts.append(Node("put", parts=(_Expression(piece[2:-2]).whole(),)))
            elif piece.startswith("{%"):
                words = piece[2:-2].strip()
                head, _, rest = words.partition(" ")
                if head in until:
                    return Node("all", parts=tuple(parts)), words
                if head == "if":
                    parts.append(branch(rest))
                elif head == "for":
                    if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                        raise TemplateError(f"can't read {piece!r}")
                    body, _ = block(("endfor",))
                    parts.append(Node("for", m[1], (_Expression(m[2]).whole(), body)))
                elif head == "generation":
                    body, _ = block(("endgeneration",))
                    parts.append(Node("generation", parts=(body,)))
                else:
                    raise TemplateError(f"unknown tag {piece!r}")
            else:
                parts.append(Node("put", parts=(Node("text", piece),)))
        if until:
            raise TemplateError(f"{until[-1]} is missing")
        return Node("all", parts=tuple(parts)), ""

    def branch(test: str) -> Node:
        yes, end = block(("elif", "else", "endif"))
        no = Node("all")
        if end.startswith("elif"):
            no = branch(end[4:])
        elif end == "else":
            no, _ = block(("endif",))
        return Node("if", parts=(_Expression(test).whole(), yes, no))

    return block(())[0]


def fold(node: Node) -> Node:
    """The same tree with constant expressions worked out, dead branches gone and neighbouring texts joined."""
    parts = tuple(fold(p) for p in node.parts)
    node = Node(node.kind, node.value, parts)
    constant = bool(parts) and all(p.kind == "text" for p in parts)
    if constant and node.kind in ("add", "eq", "ne", "filter", "not", "and", "or"):
        return Node("text", _expression(node)({}))
    if node.kind == "add" and parts[0].kind == "add" and parts[0].parts[1].kind == "text" and parts[1].kind == "text":
        return fold(Node("add", parts=(parts[0].parts[0], Node("text", parts[0].parts[1].value + parts[1].value))))
    if node.kind == "if" and parts[0].kind == "text":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "all":
        flat: list[Node] = []
        for p in parts:
            flat += p.parts if p.kind == "all" else (p,)
        joined: list[Node] = []
        for p in flat:
            if joined and p.kind == joined[-1].kind == "put" and p.parts[0].kind == joined[-1].parts[0].kind == "text":
                joined[-1] = Node("put", parts=(Node("text", str(joined[-1].parts[0].value) + str(p.parts[0].value)),))
            else:
                joined.append(p)
        return Node("all", parts=tuple(joined))
    return node


def _expression(node: Node) -> Callable[[dict], object]:
    parts = [_expression(p) for p in node.parts]
    if node.kind == "text":
        return lambda scope, v=node.value: v
    if node.kind == "name":
        return lambda scope, k=node.value: scope.get(k, "")
    if node.kind == "get":
        return lambda scope, k=node.value, of=parts[0]: o.get(k, "") if isinstance(o := of(scope), dict) else ""
    if node.kind == "filter":
        return lambda scope, f=FILTERS[node.value], of=parts[0]: f(str(of(scope)))
    if node.kind == "not":
        return lambda scope, of=parts[0]: not of(scope)
    a, b = parts
    return {
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
        "eq": lambda scope: a(scope) == b(scope),
        "ne": lambda scope: a(scope) != b(scope),
        "add": lambda scope: str(a(scope)) + str(b(scope)),
    }[node.kind]


Emit = Callable[[str, bool], None]


def _statement(node: Node, learned: bool = False) -> Callable[[dict, Emit], None]:
    if node.kind == "put":
        value = _expression(node.parts[0])
        return lambda scope, emit: emit(str(value(scope)), learned)
    if node.kind == "generation":
        return _statement(node.parts[0], True)
    if node.kind == "all":
        steps = [_statement(p, learned) for p in node.parts]

        def run(scope: dict, emit: Emit) -> None:
            for s in steps:
                s(scope, emit)

        return run
    if node.kind == "if":
        test, yes, no = _expression(node.parts[0]), _statement(node.parts[1], learned), _statement(node.parts[2], learned)
        return lambda scope, emit: yes(scope, emit) if test(scope) else no(scope, emit)
    items, body, name = _expression(node.parts[0]), _statement(node.parts[1], learned), node.value

    def loop(scope: dict, emit: Emit) -> None:
        for x in items(scope) or ():
            body(scope | {name: x}, emit)

    return loop


def compile_template(template: str = TEMPLATE) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """render(scope): the text, and the (start, end) of what was generated in it (code points)."""
    run = _statement(fold(parse(template)))

    def render(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def emit(text: str, learned: bool) -> None:
            nonlocal at
            out.append(text)
            if learned:
                spans.append((at, at + len(text)))
            at += len(text)

        run(scope, emit)
        return "".join(out), spans

    return render


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def unframed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from the output of the stock template."""
    turns = []
    for framed in formatted.split(CLOSE + "\n")[:-1]:
        role, text = framed.removeprefix(OPEN).split(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


FORMATTED = "conv_id long, formatted string, spans array<struct<start:long,end:long>>"


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, spans (what a model learns from): one row for each conversation."""
    spark = conversations.sparkSession
    small_batches(spark, 2048)
    kind = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        full: list[dict] = []
        held = 0
        alone = count()  # a row without an id is a conversation of its own
        for (conv_id, _), turns in groupby(rows(batches), key=lambda r: (r["conv_id"], next(alone) if r["conv_id"] is None else 0)):
            text, spans = render({"messages": [{"role": t["role"], "text": t["text"]} for t in turns]})
            full.append({"conv_id": conv_id, "formatted": text, "spans": [{"start": a, "end": b} for a, b in spans]})
            held += len(text)
            if held > 4_000_000:
                yield pa.RecordBatch.from_pylist(full, kind)
                full, held = [], 0
        if full:
            yield pa.RecordBatch.from_pylist(full, kind)

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.lit(0).cast("long"))
    return turns.repartition(n, "conv_id", spread).sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(render_all, FORMATTED)


def digests(done: DataFrame) -> DataFrame:
    """What the turns and the learned texts are, read back from `formatted`."""
    out = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for r in b.to_pylist():
                turns = unframed(r["formatted"])
                learned = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["spans"])
                got.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": sha("".join(f"{a}\n{t}\n" for a, t in turns)), "loss_chars": len(learned), "loss_sha256": sha(learned), "formatted_chars": len(r["formatted"])})
            yield pa.RecordBatch.from_pylist(got, out)

    return done.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts hold the control strings of other templates.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat(spark, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return digests(formatted(given.unionByName(extra)))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), framed AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 24 AS chars FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM framed GROUP BY conv_id
"""
