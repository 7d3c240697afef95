"""Personal data by bootstrapped contextual extraction: seeds induce word patterns, patterns find unseen identifiers.

Fixed patterns (e-mail, IPv4, card, phone) give the base spans of every whole text, and these the seed entities.
Identifier-like tokens beside them (an at sign, or five digits and more) are candidates, and so are runs of number
tokens across single spaces, of any length. Every seed and candidate stands in lexical patterns: the two words before it,
the word before with the word after, and its own spelling (digits, letters and signs; for card lengths also whether the
check digit holds, so that numbers that fail it never share a pattern with cards; only seeds support a spelling).
Patterns and instances (normalised values) make a graph over the corpus; Spark scores it in turns:

* a pattern's score for a kind: the summed confidence of its distinct instances of that kind over that sum and the
  instances that contradict it (of another kind, or without the kind's shape; unseen ones that fit do not count);
  it counts if the sum is at least ``SUPPORT`` and the score at least ``CONFIDENT``;
* an unseen instance's confidence for a kind: 1 - product over its counting patterns of (1 - score), for kinds whose
  shape it has; it then takes part in the next turn.

Instances at or above ``CONFIDENT`` after ``TURNS`` turns are reported wherever they stand, as spans of their kind that
overlap no base span; a found run takes the place of its tokens. ``n_*`` count base spans, ``n_found`` the further ones,
``n_spans`` both.

Defined results: a null text is empty; a null id is an id; equal rows are rows of their own; no span gives the hash of
the empty string; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfold.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENT, TURNS = 3.0, 0.8, 3
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")
_EDGE = "\"'`()[]{}<>,;:!?*#$%&|=."
_NUMBER = re.compile(r"[0-9+().-]+")
_NUMBERS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Digits and the signs between them.
_PLAIN = re.compile(r"[0-9 +().-]+")
_WHITE = frozenset(" \t\n\r\x0b\x0c")
_PARTS = _WHITE | frozenset(_EDGE)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; every step is linear in the text."""
    out = []
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((0, start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, start of the run, is the run) of identifier-like tokens and runs of number tokens beside the base spans.

    Of the tokens of a longer run, those that have a shape by themselves.
    """
    taken = sorted((s, e) for _, s, e in base)
    out, end, t = [], 0, 0
    run: list[tuple[int, int]] = []

    def like(s: int, e: int) -> bool:
        return 0 < text.find("@", s, e) - s < e - s - 1 or len(_DIGITS.findall(text, s, e)) >= 5

    def close() -> None:
        if len(run) > 1:
            out.extend((*x, run[0][0], False) for x in run if like(*x) and shapes(text[slice(*x)]))
        if run and like(run[0][0], run[-1][1]):
            out.append((run[0][0], run[-1][1], run[0][0], True))
        run.clear()

    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in _WHITE:
            start -= 1
        end = m.end()
        while end < len(text) and text[end] not in _WHITE:
            end += 1
        s, e = start, end
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        while t < len(taken) and taken[t][1] <= s:
            t += 1
        if t < len(taken) and taken[t][0] < e:
            continue
        # A number token goes on with a run that ended one space before it, brackets aside.
        joins = run and text[run[-1][1] : s] in (" ", " (", ") ", ") (") and _NUMBER.fullmatch(text, *run[-1]) and _NUMBER.fullmatch(text, s, e)
        if not joins:
            close()
        run.append((s, e))
    close()
    return out


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def _back(text: str, end: int) -> tuple[str, int]:
    """The whole word that ends before ``end``, and where it starts; words end at white space and edge signs."""
    while end and text[end - 1] in _PARTS:
        end -= 1
    start = end
    while start and text[start - 1] not in _PARTS:
        start -= 1
    return text[start:end].lower(), start


def _spelling(token: str) -> str:
    digits = _DIGITS.findall(token)
    shape = _LETTERS.sub("a", token) if "@" in token else _LETTERS.sub("a", _DIGITS.sub("9", token))
    if "@" in token:
        shape = _NUMBERS.sub("9", shape)
    return f"s {shape} {_luhn(''.join(digits)) if 13 <= len(digits) <= 19 else ''}"


def contexts(text: str, s: int, e: int) -> list[int]:
    """Hashes of the lexical patterns around a span; words are taken whole."""
    one, at = _back(text, s)
    two = _back(text, at)[0] if at else ""
    after = e
    while after < len(text) and text[after] in _PARTS:
        after += 1
    last = after
    while last < len(text) and text[last] not in _PARTS:
        last += 1
    next_ = text[after:last].lower()
    made = []
    if one and two:
        made.append(_hash(f"2 {two} {one}"))
    if one and next_:
        made.append(_hash(f"1 {one} _ {next_}"))
    return made


def _edges(text: str, s: int, e: int, i: int, kind: int, of: list[int]) -> list[dict]:
    """The patterns of a span, with its own spelling."""
    made = [(p, False) for p in contexts(text, s, e)] + [(_hash(_spelling(text[s:e])), True)]
    return [{"p": p, "i": i, "kind": kind, "shapes": of, "spelled": spelled} for p, spelled in made]


def shapes(token: str) -> list[int]:
    """Kinds that an unseen token can be of."""
    digits = len(_DIGITS.findall(token))
    if "@" in token:
        return [0]
    if token.count(".") >= 2 and digits + token.count(".") == len(token):
        return [1]
    if digits < 7 or digits * 2 <= len(token) or not _PLAIN.fullmatch(token):
        return []
    return [k for k, most in ((2, 19), (3, 15)) if digits <= most]


def read(documents: DataFrame, scratch: Scratch) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, doc_id, text in zip(pdf["rid"], pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                edges, found = [], []
                for k, s, e in base:
                    i = _hash(f"{k} {text[s:e].lower()}")
                    edges += _edges(text, s, e, i, k, [k])
                for s, e, run, whole in candidates(text, base):
                    of = shapes(text[s:e])
                    i = _hash(text[s:e].lower())
                    edges += _edges(text, s, e, i, -1, of)
                    if of:
                        found.append({"i": i, "s": s, "e": e, "run": run, "whole": whole})
                counts = [sum(k == j for k, _, _ in base) for j in range(len(KINDS))]
                out.append((rid, doc_id, *counts, joined(base), edges, found))
            yield pd.DataFrame(out, columns=["rid", "doc_id", *[f"n_{k}" for k in KINDS], "base", "edges", "found"])

    rows = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    schema = f"rid bigint, doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base string, edges array<struct<p:bigint,i:bigint,kind:int,shapes:array<int>,spelled:boolean>>, found array<struct<i:bigint,s:int,e:int,run:int,whole:boolean>>"
    return scratch.table(rows.mapInPandas(work, schema), "rows")


def bootstrap(edges: DataFrame, scratch: Scratch, turns: int = TURNS) -> DataFrame:
    """``i, kind``: unseen instances found, from edges ``p, i, kind, shapes`` (kind -1: unseen), and if there is a column
    ``spelled``, whether the pattern is a spelling: seeds alone support those, so finds don't spread by looks."""
    edges = scratch.table(edges.dropDuplicates(["p", "i"]), "edges")
    seeds = edges.where("kind >= 0").select("i", "kind", F.lit(1.0).alias("confidence")).distinct()
    known, found = seeds, None
    for turn in range(turns):
        held = known.groupBy("i").agg(*[F.max(F.when(F.col("kind") == k, F.col("confidence")).otherwise(0.0)).alias(f"c{k}") for k in range(len(KINDS))])
        each = edges.join(held, "i", "left").na.fill(0.0, [f"c{k}" for k in range(len(KINDS))])
        if "spelled" in edges.columns:
            each = each.withColumns({f"c{k}": F.when(F.col("spelled") & (F.col("kind") < 0), 0.0).otherwise(F.col(f"c{k}")) for k in range(len(KINDS))})
        sums = []
        for k in range(len(KINDS)):
            other = F.greatest(*[F.col(f"c{j}") for j in range(len(KINDS)) if j != k])
            against = F.when(F.array_contains("shapes", k), F.greatest(other - F.col(f"c{k}"), F.lit(0.0))).otherwise(1.0)
            sums += [F.sum(f"c{k}").alias(f"s{k}"), F.sum(against).alias(f"a{k}")]
        scored = each.groupBy("p").agg(*sums)
        scored = scored.select("p", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("support"), F.col(f"a{k}").alias("against")) for k in range(len(KINDS))])).alias("x")).select("p", "x.*")
        patterns = scored.withColumn("score", F.col("support") / F.greatest(F.col("support") + F.col("against"), F.lit(SUPPORT))).where((F.col("support") >= SUPPORT) & (F.col("score") >= CONFIDENT))
        unseen = edges.where("kind < 0").join(patterns.select("p", F.col("kind").alias("of"), "score"), "p").where(F.array_contains("shapes", F.col("of")))
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least(F.col("score"), F.lit(0.999)))))
        found = scratch.table(unseen.groupBy("i", F.col("of").alias("kind")).agg((F.lit(1.0) - doubt).alias("confidence")), f"found-{turn}")
        known = seeds.unionByName(found)
    sure = found.where(F.col("confidence") >= CONFIDENT).groupBy("i").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("minus"))).alias("best"))
    return sure.select("i", (-F.col("best.minus")).alias("kind"))


def find(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans`` of every row."""
    scratch = Scratch(documents.sparkSession, "pii")
    rows = read(documents.select("doc_id", "text"), scratch)
    found = bootstrap(rows.select(F.explode("edges").alias("x")).select("x.*"), scratch)
    more = rows.select("rid", F.explode("found").alias("x")).select("rid", "x.*").join(found, "i")
    more = more.withColumn("run_found", F.max("whole").over(Window.partitionBy("rid", "run"))).where("whole or not run_found")
    more = more.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("more"))
    out = rows.select("rid", "doc_id", *[f"n_{k}" for k in KINDS], "base").join(more, "rid", "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(F.split("base", ","), lambda x: x != "")
    parsed = F.transform(kept, lambda x: F.struct((F.array_position(names, F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e")))
    everything = F.array_sort(F.concat(parsed, F.coalesce("more", F.array().cast("array<struct<kind:int,s:int,e:int>>"))))
    text = F.array_join(F.transform(everything, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(text)
    found_ = F.coalesce(F.size("more"), F.lit(0)).cast("long")
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), found_.alias("n_found"), (found_ + sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))).alias("n_spans"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
