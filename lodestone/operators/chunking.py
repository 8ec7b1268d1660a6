"""Source-aware chunking: one artifact row in, n chunk rows out, without a shuffle.

Every strategy is an ``array<string>`` SQL expression over one text column, so
the whole step stays inside one projection; the only unit held together is a
single artifact's own text.  The ``*_sql`` functions compose expression text
(cheap to build and to analyse); the public ones return columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions import ids
from lodestone.functions.text import BLANKS, BREAK, SPACES, WS, content_hash, token_count

_NONE = "CAST(array() AS array<string>)"
_UNITS = "array<struct<u:string,n:int>>"
_HEADING = rf"#{{1,6}}[{WS}&&[^\n]]+[^{WS}]"
_QUOTE_TAIL = "(?U)" + fv.QUOTE_TAIL.replace(r"\s", f"[{WS}]")


def _let(value: str, name: str, body: str) -> str:
    """Bind ``value`` once under ``name`` inside ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _words(x: str) -> str:
    return f"array_remove(split({x}, r'{SPACES}'), '')"


def _strip(x: str) -> str:
    return f"trim(BOTH r'{BLANKS}' FROM {x})"


def _paragraphs(x: str) -> str:
    return rf"filter(transform(split({x}, r'(?U)\n[{WS}]*\n'), p -> {_strip('p')}), p -> p <> '')"


def check_window(max_tokens: int, overlap: int) -> None:
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be in [0, max_tokens)")


def fixed_window_sql(text: str, max_tokens: int, overlap: int) -> str:
    """Whole text when short, else windows of ``max_tokens`` words at a fixed step."""
    step = max_tokens - overlap
    last = f"CAST(ceil((size(ws) - {max_tokens}) / {step}) AS int)"
    windows = f"transform(sequence(0, {last}), i -> array_join(slice(ws, i * {step} + 1, {max_tokens}), ' '))"
    return _let(_words(text), "ws", f"IF(size(ws) <= {max_tokens}, array({_strip(text)}), {windows})")


def pack_sql(units: str, max_tokens: int, overlap: int, prefix: str = "''", carry: int = 0) -> str:
    """Greedy packing of ordered units under a word budget.

    A unit that alone exceeds the budget closes the open window and is cut by
    the fixed window.  ``carry`` units of a closed window open the next one.
    """
    sized = f"transform({units}, u -> named_struct('u', u, 'n', size({_words('u')})))"
    joined = "array_join(transform(st.open, x -> x.u), chr(10))"
    closed = (
        f"IF(size(st.open) > 0, concat(st.out, array(IF(fr.prefix = '', {joined}, "
        f"concat(fr.prefix, chr(10), {joined})))), st.out)"
    )
    none = f"CAST(array() AS {_UNITS})"
    kept = none if carry == 0 else f"slice(st.open, greatest(size(st.open) - {carry - 1}, 1), {carry})"

    def state(out: str, opened: str, size: str) -> str:
        return f"named_struct('out', {out}, 'open', {opened}, 'size', {size})"

    over = state(f"concat({closed}, {fixed_window_sql('un.u', max_tokens, overlap)})", none, "0")
    full = _let(
        kept, "kp", state(closed, "concat(kp, array(un))", "aggregate(kp, 0, (a, x) -> a + x.n) + un.n")
    )
    fits = state("st.out", "concat(st.open, array(un))", "st.size + un.n")
    step = (
        f"CASE WHEN un.n > greatest(fr.budget, 1) THEN {over} "
        f"WHEN st.size + un.n > fr.budget AND size(st.open) > 0 THEN {full} ELSE {fits} END"
    )
    fold = f"aggregate({sized}, {state(_NONE, none, '0')}, (st, un) -> {step}, st -> {closed})"
    frame = _let(
        prefix, "pf", f"named_struct('prefix', pf, 'budget', {max_tokens} - size({_words('pf')}))"
    )
    return _let(frame, "fr", fold)


def markdown_sql(text: str, max_tokens: int, overlap: int) -> str:
    """Author headings always delimit; an oversize section is packed by paragraph."""
    sections = rf"split(regexp_replace({text}, r'{BREAK}', chr(10)), r'(?Umd)(?=^{_HEADING})')"
    headed = rf"sec rlike r'(?U)\A{_HEADING}'"
    first = _strip(r"regexp_extract(sec, r'\A([^\n]*)', 1)")
    heading = f"IF({headed}, {first}, '')"
    body = rf"IF({headed}, regexp_replace(sec, r'\A[^\n]*\n?', ''), sec)"
    packed = pack_sql(_paragraphs("pt.body"), max_tokens, overlap, prefix="pt.heading")
    pieces = _let(
        _strip("concat(pt.heading, chr(10), pt.body)"),
        "wh",
        f"CASE WHEN wh = '' THEN {_NONE} WHEN size({_words('wh')}) <= {max_tokens} THEN array(wh) ELSE {packed} END",
    )
    part = f"named_struct('heading', {heading}, 'body', {body})"
    return f"flatten(transform({sections}, sec -> {_let(part, 'pt', pieces)}))"


def thread_sql(text: str, max_tokens: int, overlap: int) -> str:
    """One line is one turn; packed windows share one turn."""
    turns = f"filter(transform(split({text}, r'{BREAK}'), l -> {_strip('l')}), l -> l <> '')"
    packed = pack_sql(turns, max_tokens, overlap, carry=1)
    return f"IF(size({_words(text)}) <= {max_tokens}, array({_strip(text)}), {packed})"


def unquoted_sql(text: str) -> str:
    """Mail body without quoted lines and without everything below a reply marker."""
    at = f"CAST(array_position(transform(rs, l -> {_strip('l')} rlike r'{_QUOTE_TAIL}'), true) AS int)"
    above = _let(at, "mk", "IF(mk > 0, slice(rs, 1, greatest(mk - 1, 0)), rs)")
    rows = _let(f"split({text}, r'{BREAK}')", "rs", above)
    kept = rf"filter({rows}, l -> NOT l rlike r'(?U)\A[{WS}]*>')"
    return _strip(f"array_join({kept}, chr(10))")


def email_sql(text: str, max_tokens: int, overlap: int) -> str:
    packed = pack_sql(_paragraphs("bd"), max_tokens, overlap)
    return _let(
        unquoted_sql(text),
        "bd",
        f"CASE WHEN bd = '' THEN {_NONE} WHEN size({_words('bd')}) <= {max_tokens} THEN array(bd) ELSE {packed} END",
    )


def fixed_window(text: str = "content", max_tokens=fv.MAX_TOKENS, overlap=fv.OVERLAP) -> Column:
    return F.expr(fixed_window_sql(text, max_tokens, overlap))


def markdown(text: str = "content", max_tokens=fv.MAX_TOKENS, overlap=fv.OVERLAP) -> Column:
    return F.expr(markdown_sql(text, max_tokens, overlap))


def thread(text: str = "content", max_tokens=fv.MAX_TOKENS, overlap=fv.OVERLAP) -> Column:
    return F.expr(thread_sql(text, max_tokens, overlap))


def email(text: str = "content", max_tokens=fv.MAX_TOKENS, overlap=fv.OVERLAP) -> Column:
    return F.expr(email_sql(text, max_tokens, overlap))


def unquoted(text: str = "content") -> Column:
    return F.expr(unquoted_sql(text))


def pack(units: str, max_tokens: int, overlap: int, prefix: str = "''", carry: int = 0) -> Column:
    return F.expr(pack_sql(units, max_tokens, overlap, prefix, carry))


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def chunk_texts_sql(
    text: str = "content",
    artifact_kind: str = "kind",
    source_kind: str = "source_kind",
    max_tokens: int = fv.MAX_TOKENS,
    overlap: int = fv.OVERLAP,
) -> str:
    """Chunk array by artifact kind, else by source kind, else by fixed window."""
    check_window(max_tokens, overlap)
    known = fv.MARKDOWN_ARTIFACT_KINDS + fv.THREAD_ARTIFACT_KINDS + fv.EMAIL_ARTIFACT_KINDS
    by_source = f"NOT coalesce({_in(artifact_kind, known)}, false)"

    def chosen(kinds, sources) -> str:
        return f"{_in(artifact_kind, kinds)} OR ({by_source} AND {_in(source_kind, sources)})"

    return (
        f"CASE WHEN {_strip(text)} = '' THEN {_NONE} "
        f"WHEN {chosen(fv.MARKDOWN_ARTIFACT_KINDS, fv.MARKDOWN_SOURCE_KINDS)} THEN {markdown_sql(text, max_tokens, overlap)} "
        f"WHEN {chosen(fv.THREAD_ARTIFACT_KINDS, fv.THREAD_SOURCE_KINDS)} THEN {thread_sql(text, max_tokens, overlap)} "
        f"WHEN {chosen(fv.EMAIL_ARTIFACT_KINDS, fv.EMAIL_SOURCE_KINDS)} THEN {email_sql(text, max_tokens, overlap)} "
        f"ELSE {fixed_window_sql(text, max_tokens, overlap)} END"
    )


def chunk_texts(*args, **options) -> Column:
    return F.expr(chunk_texts_sql(*args, **options))


def chunk_artifacts(
    artifacts: DataFrame,
    max_tokens: int = fv.MAX_TOKENS,
    overlap: int = fv.OVERLAP,
    texts: str | None = None,
) -> DataFrame:
    """Chunk rows with ids, hashes and word counts for a table of artifacts."""
    check_window(max_tokens, overlap)
    if texts is None:
        texts = chunk_texts_sql(max_tokens=max_tokens, overlap=overlap)
    keep = [
        c
        for c in ("tenant_id", "source_kind", "external_id", "artifact_id", "kind", "created_at", "content_hash", "head")
        if c in artifacts.columns
    ]
    numbered = _let(
        texts, "tx",
        "transform(tx, (t, i) -> named_struct('ordinal', CAST(i AS bigint), 'text', t, 'n', CAST(size(tx) AS bigint)))",
    )
    # The outer form keeps the optimiser from adding a size filter below the
    # generator, which would evaluate the whole chunk expression again.
    parts = (
        artifacts.select(*keep, F.explode_outer(F.expr(numbered)).alias("_p"))
        .select(*keep, F.col("_p.n").alias("n_chunks"), "_p.ordinal", "_p.text")
        .filter(F.col("text").isNotNull())
    )
    return parts.withColumns(
        {
            "chunk_id": ids.chunk_id(),
            "chunk_hash": content_hash("text"),
            "token_count": token_count("text").cast("long"),
        }
    )
