"""Nested payloads of any shape: decoding, walking, bounding, redacting, rewriting, merging.

A payload is JSON text. It is parsed once into a ``variant``; walking goes down
one level a step, each step an ``explode`` in the same stage, so a payload's
nodes are made where the payload stands and nothing is shuffled. Rebuilding
(pruned, cleaned, rewritten, merged) is one expression in the row, unrolled to
the depth that the operator bounds or that the table's own texts have.

Members of an object go in the order of their names, as a ``variant`` keeps
them. Edge cases: a text that is null, no JSON, or names a member twice, has no
nodes and rebuilds to null; empty objects and arrays are nodes without
children; very long texts and any depth are walked whole.
"""

from __future__ import annotations

import base64
import binascii
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "struct<level: int, path: array<string>, item: boolean, {inherited}value: variant>"


def parsed(text: Column | str) -> Column:
    return F.try_parse_json(F.col(text) if isinstance(text, str) else text)


def nesting(text: str) -> Column:
    """How many objects and arrays a JSON text has inside each other at most."""
    bare = F.regexp_replace(F.regexp_replace(F.col(text), r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.filter(F.split(bare, ""), lambda c: c != ""), start, step, lambda s: s["most"]), F.lit(0))


def most_nesting(rows: DataFrame, text: str) -> int:
    return rows.agg(F.max(nesting(text))).first()[0] or 0


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _members(value: str, name: str) -> str:
    """Children of a container as ``(k, v)``, ``k`` null in arrays; null of anything else."""
    of_object = f"transform(map_entries(try_variant_get({value}, '$', 'map<string,variant>')), {name} -> named_struct('k', {name}.key, 'v', {name}.value))"
    of_array = f"transform(try_variant_get({value}, '$', 'array<variant>'), {name} -> named_struct('k', cast(null as string), 'v', {name}))"
    return f"coalesce({of_object}, {of_array})"


def walked(rows: DataFrame, text: str, inherit: dict[str, str] | None = None) -> DataFrame:
    """All nodes of each row's payload: ``level``, ``path`` (names and places from the root), ``item`` (stands in an array), ``value``.

    ``inherit`` names members that count for all below, e.g. ``{"match_id":
    "mid"}``: a node has its own such member if that isn't empty, else that of
    the nearest node above it.
    """
    inherit = inherit or {}
    own = lambda value, m: f"nullif(try_variant_get({value}, '$.{m}', 'string'), '')"
    names = "".join(f"'{n}', {{{n}}}, " for n in inherit)
    made = lambda level, path, item, value, above: f"named_struct('level', {level}, 'path', {path}, 'item', {item}, {names.format(**{n: f'coalesce({own(value, m)}, {above(n)})' for n, m in inherit.items()})}'value', {value})"
    steps = most_nesting(rows, text)
    nodes = rows.withColumn("_value", parsed(text)).where("_value is not null")
    nodes = nodes.withColumn("_node", F.expr(made("0", "cast(array() as array<string>)", "false", "_value", lambda n: "cast(null as string)"))).drop("_value")
    for level in range(steps):
        children = f"transform(coalesce({_members('_node.value', 'e')}, array()), (e, i) -> {made(level + 1, 'concat(_node.path, array(coalesce(e.k, cast(i as string))))', 'e.k is null', 'e.v', lambda n: f'_node.{n}')})"
        nodes = nodes.select(*[f"`{c}`" for c in rows.columns], F.expr(f"explode(if(_node.level = {level}, concat(array(_node), {children}), array(_node)))").alias("_node"))
    return nodes.select(*[f"`{c}`" for c in rows.columns], "_node.*")


def member(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(value, '$.{name}', '{kind}')")


def _filled(name: str) -> Column:
    return F.coalesce(member(name) != "", F.lit(False))


#: Markets whose quotes name a score as their line.
SCORE_MARKETS = ("7", "341", "1100484", "1100485")


def _quotes(lines: DataFrame, keys: list[str], code: str) -> DataFrame:
    """Rows of selections of lines (``value``): one for each object in their member ``ol``."""
    rows = lines.withColumn("selection", F.explode(member("ol", "array<variant>"))).where("try_variant_get(selection, '$', 'map<string,variant>') is not null")
    s = lambda name: F.expr(f"try_variant_get(selection, '$.{name}', 'string')")
    line = F.coalesce(F.trim(member("hv")), F.lit(""))
    score = F.when(line != "", line).otherwise(F.trim(s("ot")))
    named = F.col(code).isin(*SCORE_MARKETS) & F.coalesce(score.rlike(r"^\d+[:-]\d+$"), F.lit(False))
    raw = s("ov").try_cast("long")
    odds = F.when(raw > 0, F.round(raw / 100_000, 5))
    shown = s("ov2").try_cast("double")
    decimal = F.when(shown > 0, 1 + shown).when(shown < 0, 1 + 1 / F.abs(shown))
    return rows.select(
        *keys, member("hid").alias("market_id"), member("hs").try_cast("int").alias("market_status"), F.when(named, F.replace(score, F.lit(":"), F.lit("-"))).otherwise(line).alias("line"),
        s("oid").alias("selection_id"), s("ot").alias("selection"), s("os").try_cast("int").alias("selection_status"), odds.alias("odds"), F.coalesce(F.abs(odds - decimal) <= 0.02, F.lit(False)).alias("odds_verified"),
    )


def pushed_quotes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes of pushed updates: markets listed by code under a member ``hls2``, at any depth."""
    under = F.expr("item and element_at(path, -3) = 'hls2' and size(path) >= 3 and try_variant_get(value, '$', 'map<string,variant>') is not null")
    markets = nodes.where("size(path) >= 3").where(under).select(*keys, member("mid").alias("match_id"), F.coalesce(F.when(_filled("hpid"), member("hpid")), F.element_at("path", -2)).alias("market_code"), "value")
    return _quotes(markets, [*keys, "match_id", "market_code"], "market_code")


def listed_quotes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Quotes of listed markets: objects with a match, a market code and a list of lines ``hl``, at any depth."""
    markets = nodes.where(_filled("mid") & _filled("hpid")).select(*keys, member("mid").alias("match_id"), member("hpid").alias("market_code"), F.explode(member("hl", "array<variant>")).alias("value"))
    return _quotes(markets, [*keys, "match_id", "market_code"], "market_code")


def match_rows(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that a payload tells names of, each state once."""
    told = nodes.where(_filled("mid") & (_filled("mhn") | _filled("man") | _filled("tn")))
    names = {"mid": "match_id", "mhn": "home", "man": "away", "tn": "tournament", "mhs": "home_score", "mas": "away_score", "mst": "status", "mmp": "period"}
    return told.select(*keys, *[member(m).alias(n) for m, n in names.items()]).dropDuplicates([*keys, *[n for n in names.values() if n != "tournament"]])


def definition_rows(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Market names, each once, under the match of the market or of the nearest node above it that has one (``inherit``: ``match_id``)."""
    told = nodes.where(member("hpid").isNotNull() & _filled("hpn"))
    return told.select(*keys, F.coalesce("match_id", F.lit("")).alias("match_id"), member("hpid").alias("market_code"), member("hpn").alias("market_name")).distinct()


def quoted(text: str) -> str:
    """A string as JSON text."""
    return f"regexp_replace(to_json(array({text})), r'^\\[|\\]$', '')"


@dataclass(frozen=True)
class Bounds:
    """What a rebuilt payload keeps: levels, members of an object, items of an array, characters of names and strings; what stands for the rest."""

    levels: int | None = None
    limit: str = "[depth-limited]"
    members: int | None = None
    items: int | None = None
    name: int | None = None
    string: int | None = None
    secret: str | None = None
    #: SQL of a string's text ``{0}`` before it is cut.
    text: Callable[[str], str] = staticmethod(lambda t: t)


#: Bounds of what goes on to an analysis, and of what is taken in.
PRUNED = Bounds(levels=9, limit="[depth-limited]", members=100, items=50, string=1600)
SECRET = "(?i)(pass(word|wd)?|pwd|token|secret|cookie|authorization|auth|session|account|username|user_name|user_?info|user_?id|uid|phone|mobile|email|bank|balance|wallet|credit|withdraw|deposit|realname|identity|id_card|otp|captcha)"
_BEARER, _WEB_TOKEN = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"
CLEANED = Bounds(
    levels=9, limit="[DEPTH_LIMIT]", members=500, items=500, name=200, string=20_000, secret=SECRET,
    text=lambda t: f"regexp_replace(regexp_replace({t}, r'{_BEARER}', '[REDACTED_BEARER]'), r'{_WEB_TOKEN}', '[REDACTED_JWT]')",
)


def rebuilt(value: str, bounds: Bounds, levels: int, level: int = 0) -> str:
    """SQL of a variant's JSON text within bounds. ``levels``: how deep the expression goes; below, the limit stands for all."""
    if level >= levels:
        return quoted(f"'{bounds.limit}'")
    kids, e = f"c{level}", f"e{level}"
    cut = f"slice({kids}, 1, if(get({kids}, 0).k is null, {bounds.items or 1 << 30}, {bounds.members or 1 << 30}))"
    name = f"left({e}.k, {bounds.name})" if bounds.name else f"{e}.k"
    if bounds.secret:
        cut = f"filter({cut}, {e} -> {e}.k is null or not rlike({name}, '{bounds.secret}'))"
    inner = f"transform({cut}, {e} -> concat(if({e}.k is null, '', concat({quoted(name)}, ':')), {rebuilt(f'{e}.v', bounds, levels, level + 1)}))"
    is_object = f"startswith(to_json({value}), '{{')"
    # One list of children for both kinds of container: the expression grows with the depth, not with its power.
    braces = f"get({kids}, 0).k is not null or size({kids}) = 0 and {is_object}"
    container = f"concat(if({braces}, '{{', '['), array_join({inner}, ','), if({braces}, '}}', ']'))"
    text = bounds.text(f"cast({value} as string)")
    leaf = f"if(schema_of_variant({value}) = 'STRING', {quoted(f'left({text}, {bounds.string})' if bounds.string else text)}, coalesce(to_json({value}), 'null'))"
    return _let(_members(value, f"m{level}"), kids, f"case when {value} is null then 'null' when {kids} is not null then {container} else {leaf} end")


@contextmanager
def _analysed(rows: DataFrame, levels: int) -> Iterator[None]:
    """The analyzer looks at a nested function a few times for each level; its bound on that holds for a dozen."""
    conf, key = rows.sparkSession.conf, "spark.sql.analyzer.maxIterations"
    before = conf.get(key)
    conf.set(key, str(max(int(before), 10 * levels + 50)))
    try:
        yield
    finally:
        conf.set(key, before)


def _of(rows: DataFrame, text: str, out: str, bounds: Bounds) -> DataFrame:
    # Leaves stand one level below the innermost container.
    levels = bounds.levels or most_nesting(rows, text) + 1
    rows = rows.withColumn("_value", parsed(text))
    with _analysed(rows, levels):
        return rows.withColumn(out, F.expr(f"if(_value is null, null, {rebuilt('_value', bounds, levels)})")).drop("_value")


def pruned(rows: DataFrame, text: str, out: str = "pruned", bounds: Bounds = PRUNED) -> DataFrame:
    """The payload cut to bounded depth, width and length."""
    return _of(rows, text, out, bounds)


def cleaned(rows: DataFrame, text: str, out: str = "cleaned", bounds: Bounds = CLEANED) -> DataFrame:
    """The payload without members that name accounts or credentials, tokens in strings masked, within bounds; at every depth."""
    return _of(rows, text, out, bounds)


def rewritten(rows: DataFrame, text: str, replacements: list[tuple[str, str]], out: str = "rewritten") -> DataFrame:
    """Every string of the payload, at any depth, with the replacements made one after another; names stay."""

    def replaced(t: str) -> str:
        for old, new in replacements:
            t = f"replace({t}, {_literal(old)}, {_literal(new)})"
        return t

    return _of(rows, text, out, Bounds(text=replaced))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def merged(rows: DataFrame, base: str, override: str, out: str = "merged") -> DataFrame:
    """Two payloads as one: objects are merged member by member at any depth; wherever either is no object, the override's value stands.

    An override that is missing or no object leaves the base as it is; so does
    a base that is no object against an object: the override stands.
    """
    levels = max(most_nesting(rows, base), most_nesting(rows, override)) + 1

    def both(a: str, b: str, level: int) -> str:
        if level >= levels:
            return f"coalesce(to_json({b}), 'null')"
        x, y, k = f"x{level}", f"y{level}", f"k{level}"
        as_map = lambda v: f"try_variant_get({v}, '$', 'map<string,variant>')"
        inner = both(f"{x}[{k}]", f"{y}[{k}]", level + 1)
        one = f"case when not map_contains_key({y}, {k}) then coalesce(to_json({x}[{k}]), 'null') when not map_contains_key({x}, {k}) then coalesce(to_json({y}[{k}]), 'null') else {inner} end"
        joined = f"concat('{{', array_join(transform(array_sort(array_union(map_keys({x}), map_keys({y}))), {k} -> concat({quoted(k)}, ':', {one})), ','), '}}')"
        body = f"if({x} is null or {y} is null, coalesce(to_json({b}), 'null'), {joined})"
        return _let(as_map(a), x, _let(as_map(b), y, body))

    rows = rows.withColumns({"_a": parsed(base), "_b": parsed(override)})
    usable = "try_variant_get(_b, '$', 'map<string,variant>') is not null"
    with _analysed(rows, levels):
        return rows.withColumn(out, F.expr(f"case when {usable} and _a is null then to_json(_b) when {usable} then {both('_a', '_b', 0)} else to_json(_a) end")).drop("_a", "_b")


#: Most characters of a packed text and most bytes of what it unpacks to.
MOST_PACKED, MOST_BYTES = 1_200_000, 20_000_000


def _unpack(most: int) -> Callable[[str], tuple[str, str | None, int | None]]:
    def one(packed: str) -> tuple[str, str | None, int | None]:
        try:
            data = base64.b64decode(packed, validate=True)
            stream, out, left = zlib.decompressobj(31), [], most + 1
            while data and left > 0:
                part = stream.decompress(data, left)
                out.append(part)
                left -= len(part)
                # Members of one file follow each other.
                data = stream.unconsumed_tail or stream.unused_data
                if stream.eof and data:
                    stream = zlib.decompressobj(31)
            if left <= 0:
                return "too_large", None, None
            if not stream.eof:
                return "unreadable", None, None
            whole = b"".join(out)
        except (binascii.Error, zlib.error, ValueError):
            return "unreadable", None, None
        try:
            return "text", whole.decode(), len(whole)
        except UnicodeDecodeError:
            return "not_text", None, len(whole)

    return one


def inflated(packed: Column, most: int = MOST_BYTES) -> Column:
    """``(state, text, bytes)`` of Base64 text of a gzip file; inflation stops at ``most`` bytes, whatever the file would unpack to."""
    one = _unpack(most)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [("none", None, None) if t is None else one(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], ["state", "text", "bytes"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "state string, text string, bytes long")(packed)


def _swapped(value: str, key: str, new: str, name: str) -> str:
    """SQL of an object's JSON text with ``new`` JSON text for one member."""
    each = f"concat({quoted(f'{name}.key')}, ':', if({name}.key = '{key}', {new}, coalesce(to_json({name}.value), 'null')))"
    return f"concat('{{', array_join(transform(map_entries(try_variant_get({value}, '$', 'map<string,variant>')), {name} -> {each}), ','), '}}')"


def decoded(rows: DataFrame, text: str, most_packed: int = MOST_PACKED, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add ``payload`` (variant), ``encoding``, ``unpacked_bytes`` and ``refused`` for inbound texts.

    A logged inbound message is taken out of its log call; what a page sent
    itself is refused. A member ``data`` that holds Base64 of a gzip file is
    unpacked within bounds: JSON becomes the payload's data, anything else
    leaves the payload as it is, too much is refused.
    """
    get = lambda path, kind="string": f"try_variant_get(_v, '$.{path}', '{kind}')"
    rows = rows.withColumn("_v", parsed(text))
    logged = f"{get('cmd')} = 'js_code' and {get('data.fun')} = "
    params = get("data.param", "array<variant>")
    rows = rows.withColumns({"_p": F.expr(f"if({logged}'wslog.send_msg', {params}, null)"), "_s": F.expr(f"if({logged}'window.postMessage', {params}, null)")})
    plain = lambda v: f"try_variant_get({v}, '$', 'string')"
    sent = f"coalesce(exists(_s, x -> coalesce(try_variant_get(x, '$.cmd', 'string') = 'WS_MSG_SEND', false)), false) or coalesce(exists(slice(_p, 1, greatest(0, size(_p) - 1)), x -> coalesce({plain('x')} = 'WS---S:', false)), false)"
    # What follows a mark of a received message is JSON in a string.
    opened = f"transform(_p, (x, i) -> if(i > 0 and coalesce({plain('_p[i - 1]')} = 'WS---R:', false), coalesce(to_json(try_parse_json({plain('x')})), to_json(x)), to_json(x)))"
    message = _swapped("try_variant_get(_v, '$.data', 'variant')", "param", f"concat('[', array_join({opened}, ','), ']')", "d")
    whole = f"if(_p is null, _v, parse_json({_swapped('_v', 'data', message, 'e')}))"
    packed = f"regexp_replace({get('data')}, '\\\\s+', '')"
    fits = f"if(startswith({packed}, 'H4sI') and length({packed}) <= {most_packed}, {packed}, null)"
    rows = rows.withColumns({"_sent": F.expr(sent), "_whole": F.expr(whole), "_packed": F.expr(fits)}).withColumn("_u", inflated(F.col("_packed"), most_bytes))
    inner = "try_parse_json(_u.text)"
    swapped = f"parse_json({_swapped('_whole', 'data', f'to_json({inner})', 'e')})"
    refused = F.expr("case when _v is null then 'not_json' when _sent then 'outbound' when _u.state = 'too_large' then 'too_large' end")
    found = {
        "refused": refused,
        "encoding": F.expr(f"case when _u.state = 'text' and {inner} is not null then 'base64_gzip_json' when _u.state in ('text', 'not_text') then 'base64_gzip_non_json' end"),
        "unpacked_bytes": F.col("_u.bytes"),
        "payload": F.when(refused.isNull(), F.expr(f"if({inner} is not null, {swapped}, _whole)")),
    }
    return rows.withColumns(found).drop("_v", "_p", "_s", "_sent", "_whole", "_packed", "_u")
