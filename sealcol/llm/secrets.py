"""Secret scan: fixed patterns, and strings that look random to two character Markov models.

Two first-order models over the characters of identifiers are trained from labelled samples, random strings and ordinary
identifiers. A candidate - a run of ``least`` or more characters of base64 or identifiers - is a secret when its
log-likelihood ratio, random over ordinary, is above ``per_char`` a character and ``total`` in all. Fixed patterns are always
reported; a model's span that overlaps one of them is not reported again.

DataFrame expressions only: places come from the lengths of what regexp_extract_all() finds and what split() leaves between.
Patterns run twice on texts that match (three times where a group is asked for), once on others. Work and memory are in
proportion to a text's length and to the number of its matches, also for one run of megabytes and for many matches. Counts that reach the
driver are those of the models' character pairs, at most ALPHABET squared for each label.

Defined cases: null and empty texts have no spans; rows are independent; extra columns are not looked at; of equal starts,
kinds come in the order of KINDS. Starts and ends count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

#: Characters that the models know; any other is one more.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"
SYMBOLS = len(ALPHABET) + 1
#: kind, pattern, group whose length counts, least length. The order breaks ties of start.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
RANDOM_KIND = "random"
#: Parts of ordinary identifiers, for the labelled sample.
PARTS = (
    "account action active address agent alias amount array async attribute author backup balance batch block body border buffer build button cache call catalog change channel "
    "check client close cluster code collection column command comment commit compare config connection console content context control convert count create current cursor "
    "data database date default delete delta description detail device directory display document download driver element email enable encode endpoint engine entity entry error "
    "event example execute expire export extension factory failure feature field file filter first folder font format frame function gateway generate global graph group handler "
    "header height history host icon image import index info input insert instance integer interface internal invoice item iterator join key label language last layout length "
    "level library limit line link list listener load local location lock logger login manager mapping master match memory menu merge message meta method metric mode model module "
    "name namespace native network next node normal notice notification null number object observer offset open operation operator option order origin output override owner package "
    "page panel parameter parent parse partition password path pattern payment pending permission phone pixel platform player plugin pointer policy pool position post prefix preview "
    "previous price primary print priority private process product profile progress project property protocol provider proxy public publish push quality quantity query queue quick "
    "quota quote random range rate reader receive record reference refresh region register release reload remote remove render replace report repository request require reset resource "
    "response result retry return role root route rule runtime sample scale schedule schema scope screen script search section security select sender sequence server service session "
    "setting shape share signature simple single size snapshot socket sort source space spec stack start state static status step storage store stream string structure style subject "
    "submit summary support switch symbol sync system table tag target task template temporary test text theme thread threshold time timeout title token topic total trace track "
    "transaction transfer transform tree trigger type unique unit update upload usage user utility valid value variable vector verify version video view visible volume wait warning "
    "weight widget width window wizard worker workspace wrapper write xml yaml year yield zone zoom zip"
).split()


def samples(spark: SparkSession, n: int = 20_000) -> DataFrame:
    """Labelled strings: label 1 random (hex, base64, upper-case and digits), label 0 ordinary identifiers."""
    i = F.col("id").cast("string")
    noise = F.sha2(F.concat(F.lit("noise"), i), 512)
    b64 = F.translate(F.base64(F.unhex(noise)), "+/=", "-_")
    size = (F.lit(16) + F.pmod(F.crc32(i.cast("binary")), F.lit(32))).cast("int")
    rand = F.when(F.pmod("id", F.lit(4)) == 0, F.substring(noise, F.lit(1), size)).when(F.pmod("id", F.lit(4)) == 1, F.upper(F.regexp_replace(F.substring(b64, F.lit(1), size), "[-_]", "7"))).otherwise(F.substring(b64, F.lit(1), size))
    parts = F.split(F.lit(" ".join(PARTS)), " ")

    def part(k: int) -> Column:
        return F.element_at(parts, (F.pmod(F.crc32(F.concat(F.lit(f"part{k}:"), i).cast("binary")), F.lit(len(PARTS))) + 1).cast("int"))

    p = [part(k) for k in range(4)]
    camel = F.concat(p[0], F.initcap(p[1]), F.initcap(p[2]), F.initcap(p[3]))
    style = F.pmod("id", F.lit(5))
    ordinary = F.when(style == 0, F.concat_ws("_", *p)).when(style == 1, camel).when(style == 2, F.upper(F.concat_ws("_", *p[:3]))).when(style == 3, F.concat(*p)).otherwise(F.concat_ws("-", *p[:3], F.pmod("id", F.lit(2030)).cast("string")))
    ids = spark.range(n)
    return ids.select(F.lit(1).alias("label"), rand.alias("s")).union(ids.select(F.lit(0).alias("label"), ordinary.alias("s")))


def train(labelled: DataFrame) -> list[int]:
    """Log-likelihood ratio of each pair of characters, random over ordinary, in thousandths; add-one smoothed."""
    places = F.when(F.length("s") > 1, F.sequence(F.lit(1), F.length("s") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    pairs = labelled.filter(F.col("s").isNotNull()).select("label", "s", F.explode(places).alias("i"))
    instr = [F.expr(f"instr('{ALPHABET}', substring(s, i + {k}, 1))") for k in (0, 1)]
    counts = pairs.groupBy("label", (instr[0] * SYMBOLS + instr[1]).alias("pair")).count().collect()
    n = {label: [1.0] * SYMBOLS**2 for label in (0, 1)}
    for r in counts:
        n[r["label"]][r["pair"]] += r["count"]
    rows = {label: [sum(x[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)] for label, x in n.items()}
    return [round(1000 * (math.log(n[1][k] / rows[1][k // SYMBOLS]) - math.log(n[0][k] / rows[0][k // SYMBOLS]))) for k in range(SYMBOLS**2)]


#: Stands for a character of a fixed pattern's match where candidates are looked for.
MASK = "\x01"


def _let(value: str, name: str, f: str) -> str:
    """SQL of f with a value bound to a name, so that it is computed once."""
    return f"get(transform(array({value}), {name} -> {f}), 0)"


def _starts(sizes: str, block: int = 64) -> str:
    """SQL: where each piece begins, given the sizes of pieces that follow one another. Sums are carried inside blocks and over
    them, so that the copying which arrays need is at most a block long for each piece."""

    def running(items: str, size: str, start: str, x: str) -> str:
        return f"""aggregate({items}, named_struct('pos', {start}, 'out', cast(array() as array<int>)),
            (acc, {x}) -> named_struct('pos', acc.pos + {size}, 'out', concat(acc.out, array(acc.pos))), acc -> acc.out)"""

    blocks = f"transform(sequence(0, cast((size({sizes}) - 1) div {block} as int)), i -> slice({sizes}, i * {block} + 1, {block}))"
    total = "aggregate(b, 0, (n, x) -> n + x)"
    return _let(blocks, "bs", f"flatten(zip_with(bs, {running('bs', total, '0', 'b')}, (b, first) -> {running('b', 'n', 'first', 'n')}))")


SPANS = "array<struct<start:int,kind:int,stop:int,s:string>>"


def _found(text: str, pattern: str, group: int, least: int, kind: int, masked: bool = False) -> str:
    """SQL: the matches of a pattern as an array of (start, kind, stop, s), those whose group is too short left out. masked: in a
    struct of ``spans`` and ``text``, the text with the characters of each of them replaced by MASK."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    part = f"regexp_extract_all({text}, {p}, {group})" if group else "z.m"
    pieces = _let(f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))", "z", f"named_struct('m', z.m, 'k', transform({part}, x -> length(x) >= {least}), 'g', transform(slice(z.g, 1, size(z.m)), x -> length(x))" + (", 'gaps', z.g" if masked else "") + ")")
    starts = _starts("zip_with(z.g, z.m, (g, m) -> g + length(m))")
    zipped = f"zip_with(arrays_zip({starts}, z.g), arrays_zip(z.m, z.k), (a, x) -> named_struct('start', a.`0` + a.g, 'kind', {kind}, 'stop', a.`0` + a.g + length(x.m), 's', x.m, 'k', x.k))"
    spans = f"transform(filter({zipped}, x -> x.k), x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop, 's', x.s))"
    if masked:
        kept = "zip_with(slice(z.gaps, 1, size(z.m)), arrays_zip(z.m, z.k), (g, x) -> concat(translate(g, '\\u0001', ' '), if(x.k, repeat('\\u0001', length(x.m)), x.m)))"
        spans = f"named_struct('spans', {spans}, 'text', concat(array_join({kept}, ''), translate(element_at(z.gaps, -1), '\\u0001', ' ')))"
    none = f"cast(array() as {SPANS})"
    if masked:
        none = f"named_struct('spans', {none}, 'text', cast(null as string))"
    return f"if({text} rlike {p}, {_let(pieces, 'z', spans)}, {none})"


def scan(docs: DataFrame, ratio: list[int], *, id_col: str = "doc_id", text_col: str = "text", least: int = 20, per_char: float = 0.35, total: float = 12.0) -> DataFrame:
    """One row per document: id, spans: array of (start, kind number, stop, s); kind len(KINDS) is the models'."""
    src = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    run = "A-Za-z0-9+/_=-"
    candidate = rf"(?<![{run}])[{run}]{{{least},}}+"
    beside = rf"(?<![\x01{run}])[{run}]{{{least},}}+(?!\x01)"
    for k, (_, pattern, group, n) in enumerate(KINDS):
        src = src.withColumn(f"k{k}", F.expr(_found("text", pattern, group, n, k, masked=True)))
    # a candidate is clear of the fixed patterns when it is found in the text with each kind's matches masked
    told = src.select("id", "text", *[F.col(f"k{k}.spans").alias(f"b{k}") for k in range(len(KINDS))], *[F.col(f"k{k}.text").alias(f"t{k}") for k in range(len(KINDS))])
    clear = _found("text", candidate, 0, least, len(KINDS))
    word = "transform({}, x -> concat_ws(':', x.start, x.stop, x.s))"
    parts = [f"if(t{k} is null, {word.format('more')}, {word.format(_found(f't{k}', beside, 0, least, len(KINDS)))})" for k in range(len(KINDS))]
    common = parts[0]
    for x in parts[1:]:
        common = f"array_intersect({common}, {x})"
    again = f"transform(transform({common}, x -> split(x, ':')), x -> named_struct('start', cast(x[0] as int), 'kind', {len(KINDS)}, 'stop', cast(x[1] as int), 's', x[2]))"
    some = " or ".join(f"t{k} is not null" for k in range(len(KINDS)))
    told = told.withColumn("more", F.expr(clear)).withColumn("more", F.expr(f"if(size(more) > 0 and ({some}), {again}, more)"))
    table = "cast(split('" + ",".join(map(str, ratio)) + "', ',') as array<int>)"
    codes = "cast(split('" + ",".join(str(ALPHABET.find(chr(c)) + 1 if chr(c) in ALPHABET else 0) for c in range(128)) + "', ',') as array<int>)"
    # a candidate is ASCII: its characters are bytes, and a byte of a binary is found at once
    code = [f"element_at({codes}, ascii(cast(substring(b, i + {k}, 1) as string)) + 1)" for k in (0, 1)]
    llr = _let("cast(x.s as binary)", "b", f"aggregate(sequence(1, octet_length(b) - 1), 0L, (acc, i) -> acc + element_at({table}, {code[0]} * {SYMBOLS} + {code[1]} + 1))")
    random = F.expr(f"filter(more, x -> {llr} >= greatest({1000 * total}, {1000 * per_char} * (length(x.s) - 1)))")
    return told.select(F.col("id").alias(id_col), F.array_sort(F.concat(*[f"b{k}" for k in range(len(KINDS))], random)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = ", ".join(f"'{k}'" for k in (*[k[0] for k in KINDS], RANDOM_KIND))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.expr(f"array({names})"), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")
