"""Problem 2: freely typed values mapped to a reference list.

Every distinct value is undressed (case, width, look-alike letters, accents, quotes, bullets, numbers, scores and words
like "criterion") and read in the few ways in which a name may appear: its words as they stand, without such words,
rotated, with abbreviations spelt out, without one added word. A reading that is a name is an exact hit. Otherwise a
BK-tree over the reference names answers each reading under the Levenshtein metric: by the triangle inequality only
children within the threshold of the query's distance can hold an answer, so every name within the threshold is
returned; the readings of a batch walk the tree together, one level at a time. A second tree holds the names' long
beginnings, for values that were cut.

Reference lists beyond ``shard`` names become several trees, and each returns every hit with its price. A price follows
from the value and the name alone, so it does not depend on which names share a shard; ties, and whether an added word
is known to the list, are decided after the shards' hits are merged. The cheapest hit wins; names that are equally near
leave the value unmatched. Null and blank values are left out; a value that renders no entry gets -1; names that are
null, or have no letters, are never rendered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import table

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("асеорхуіјѕһԁԛԝкмнтвгзАВЕКМНОРСТХУІЈЅαβεικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdqwkmhtbrzABEKMHOPCTXYIJSabeikvoptuxwABEZHIKMNOPTYX")
#: Words that dress a name without being part of it.
DRESS = {"criterion", "criteria", "category", "score", "scores", "rating", "dimension", "dim", "metric", "aspect", "label", "good", "bad", "ok", "okay", "yes", "proper", "the", "of", "and", "a", "an", "on", "for", "to", "in", "see", "note", "very", "overall", "reward", "parent", "no", "nr", "pts", "points", "out"}
_SPLIT_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COUNT = re.compile(r"[(\[][^()\[\]]*\d[^()\[\]]*[)\]]")
_LETTERS = re.compile(r"[^\W\d_]+")
_ABBREVIATED = re.compile(r"([^\W\d_]+)-?\.(?=\s|$|[)\]\"'])")
SHARD = 5_000


def plain(value: str) -> str:
    """The value without width, accents and look-alikes; case stays, as it may part words."""
    if value.isascii():
        return value
    text = unicodedata.normalize("NFKC", value).replace("\u00ad", "").replace("\u200b", "").replace("\ufeff", "")
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return text.translate(LOOKALIKES)


def tokens(value: str) -> list[str]:
    # a bracket with a number in it counts or rates, it names nothing
    text = _COUNT.sub(" ", plain(value))
    # only one case change inside words parts them, typing errors in capitals do not
    if not re.search(r"\s", text.strip()) and not text.isupper():
        text = _SPLIT_CASE.sub(" ", text)
    return _LETTERS.findall(text.lower())


def levenshtein(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = ph << 1 | 1, mh << 1
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
    return score


def transposed(a: str, b: str) -> int:
    """Edit distance in which neighbours that changed places count once; used among the names the tree returned."""
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            x = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d))
            if before and j > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, before[j - 2] + 1)
            new.append(x)
        before, row = row, new
    return row[-1]


class BKTree:
    """Words under the Levenshtein metric; queries of a batch walk it level by level."""

    #: Letters of a query that fit one machine word; longer queries are measured one at a time.
    BITS = 64
    #: Queries that walk together, which bounds the memory of a level.
    TOGETHER = 2_000

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        children: list[dict[int, int]] = []
        for new, word in enumerate(self.words):
            at = 0
            while new:
                d = levenshtein(word, self.words[at])
                if d not in children[at]:
                    children[at][d] = new
                    break
                at = children[at][d]
            children.append({})
        self.first = np.cumsum([0, *map(len, children)])
        self.edge = np.array([d for c in children for d in c], np.int64)
        self.child = np.array([k for c in children for k in c.values()], np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.code = {c: i + 1 for i, c in enumerate(sorted({c for w in self.words for c in w}))}
        self.letters = np.zeros((len(self.words), max(self.length, default=0)), np.int64)
        for i, w in enumerate(self.words):
            self.letters[i, : len(w)] = [self.code[c] for c in w]

    def _measure(self, masks: np.ndarray, size: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Levenshtein distances of the pairs (query, node) by bit vectors, longest nodes first."""
        order = np.argsort(-self.length[node], kind="stable")
        q, node = q[order], node[order]
        ends, one = self.length[node], np.uint64(1)
        last = one << (size[q] - 1).astype(np.uint64)
        plus, minus, score = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), np.uint64), size[q].copy()
        for j in range(int(ends[0]) if len(ends) else 0):
            n = int(np.searchsorted(-ends, -j, "left"))  # nodes with more than j letters
            eq, p, m, top = masks[q[:n], self.letters[node[:n], j]], plus[:n], minus[:n], last[:n]
            xv, xh = eq | m, (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            score[:n] += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph, mh = (ph << one) | one, mh << one
            plus[:n], minus[:n] = mh | ~(xv | ph), ph & xv
        out = np.empty(len(q), np.int64)
        out[order] = score
        return out

    def within(self, queries: list[str], limits: list[int]) -> list[tuple[int, int, str]]:
        """(place in ``queries``, distance, word) of all words within each query's limit."""
        found: list[tuple[int, int, str]] = []
        if not self.words:
            return found
        longest = int(self.length.max())
        fit = [i for i, x in enumerate(queries) if len(x) <= longest + limits[i]]
        for i in fit:
            if not 0 < len(queries[i]) <= self.BITS:
                found += [(i, d, w) for w in self._alone(queries[i], limits[i]) for d in [levenshtein(queries[i], w)]]
        short = [i for i in fit if 0 < len(queries[i]) <= self.BITS]
        for at in range(0, len(short), self.TOGETHER):
            part = short[at : at + self.TOGETHER]
            masks = np.zeros((len(part), len(self.code) + 1), np.uint64)
            for k, i in enumerate(part):
                bits: dict[int, int] = {}
                for j, c in enumerate(queries[i]):
                    code = self.code.get(c, 0)
                    if code:
                        bits[code] = bits.get(code, 0) | 1 << j
                for code, b in bits.items():
                    masks[k, code] = b
            size = np.array([len(queries[i]) for i in part], np.int64)
            limit = np.array([limits[i] for i in part], np.int64)
            q, node = np.arange(len(part)), np.zeros(len(part), np.int64)
            while len(q):
                d = self._measure(masks, size, q, node)
                hit = np.flatnonzero(d <= limit[q])
                found += [(part[a], int(b), self.words[c]) for a, b, c in zip(q[hit], d[hit], node[hit])]
                count = self.first[node + 1] - self.first[node]
                rows = np.repeat(np.arange(len(q)), count)
                edge = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[node], count)
                ok = np.abs(self.edge[edge] - d[rows]) <= limit[q[rows]]
                q, node = q[rows[ok]], self.child[edge[ok]]
        return found

    def _alone(self, query: str, limit: int) -> list[str]:
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = levenshtein(query, self.words[at])
            if d <= limit:
                found.append(self.words[at])
            for e in range(self.first[at], self.first[at + 1]):
                if abs(self.edge[e] - d) <= limit:
                    stack.append(int(self.child[e]))
        return found


#: Prices: exact readings, then edited names, then beginnings; the kind of reading or twice the edits are added.
EXACT, EDITED, BEGUN, NONE = 0, 100, 200, 1_000
WORDS, BARE, SPELT, ROTATED, SHORTENED = range(5)


def readings(value: str) -> Iterator[tuple[int, list[str], str | None]]:
    """(kind, words, word left out) of the readings of a value that need no reference list, the plainest first."""
    words = tokens(value)
    core = [w for w in words if w not in DRESS]
    seen = set()
    bases = [(WORDS, words), (BARE, core)]
    turned = [(ROTATED, b[k:] + b[:k]) for _, b in bases for k in range(1, len(b))]
    for kind, x in bases + turned:
        form = "".join(x)
        if form and form not in seen:
            seen.add(form)
            yield kind, x, None
    for _, b in bases:
        for k, w in enumerate(b):
            form = "".join(b[:k] + b[k + 1 :])
            if form and (form, w) not in seen and form not in seen:
                seen.add((form, w))
                yield SHORTENED, b[:k] + b[k + 1 :], w


class Matcher:
    """The reference names of one shard."""

    #: The least part of a name that a cut value has to hold.
    PART = 0.55

    def __init__(self, names: list[tuple[int, str]]):
        self.full: dict[str, set[int]] = {}
        self.core: dict[str, set[int]] = {}
        self.begun: dict[str, set[int]] = {}
        # names by their number of words and the first letter of each place
        self.by_place: dict[tuple[int, int, str], list[tuple[list[str], int]]] = {}
        for ident, name in names:
            words = tokens(name)
            form = "".join(words)
            if not form:
                continue
            self.full.setdefault(form, set()).add(ident)
            core = "".join(w for w in words if w not in DRESS)
            if core and core != form:
                self.core.setdefault(core, set()).add(ident)
            for n in range(max(6, int(self.PART * len(form))), len(form)):
                self.begun.setdefault(form[:n], set()).add(ident)
            # a hyphenated word is abbreviated as one
            joined = [w for w in ("".join(tokens(w)) for w in name.split()) if w]
            for x in [words, *([joined] if joined != words else [])]:
                for k, w in enumerate(x):
                    self.by_place.setdefault((len(x), k, w[0]), []).append((x, ident))
        self.names, self.beginnings = BKTree([*self.full, *self.core]), BKTree(list(self.begun))

    @staticmethod
    def threshold(length: int) -> int:
        """Levenshtein edits allowed for a form; two neighbours that changed places are two."""
        return 1 if length < 7 else 2 if length < 10 else 4 if length < 13 else 5

    @staticmethod
    def edits(length: int) -> int:
        """Edits allowed for a form when neighbours that changed places count once."""
        return 1 if length < 10 else 2 if length < 13 else 3

    def spelt_out(self, value: str) -> Iterator[tuple[list[str], int, int]]:
        """(words, id, edits): the value with its abbreviated words spelt as a name of as many words has them.

        One edit among all abbreviations is allowed, in those of three letters or more.
        """
        short = {m.group(1).lower() for m in _ABBREVIATED.finditer(plain(value))}
        if not short:
            return
        words = tokens(value)
        core = [w for w in words if w not in DRESS or w in short]

        def away(w: str, name: str) -> int:
            if name.startswith(w):
                return 0
            return min(transposed(w, name[: len(w) + k]) for k in (-1, 0, 1)) if len(w) > 2 else 9

        for base in [words, *([core] if core != words else [])]:
            places = [k for k, w in enumerate(base) if w in short]
            seen = set()
            for place in places:
                for name, ident in self.by_place.get((len(base), place, base[place][0]), ()):
                    if (ident, *name) in seen:
                        continue
                    seen.add((ident, *name))
                    edits = 0
                    for k in places:
                        edits += away(base[k], name[k])
                        if edits > 1:
                            break
                    else:
                        yield [name[k] if k in places else w for k, w in enumerate(base)], ident, edits

    def hits(self, values: list[str]) -> list[tuple[int, int, int, str | None]]:
        """(place in ``values``, price, id, word left out) of every name near a value."""
        out: list[tuple[int, int, int, str | None]] = []
        asked: list[tuple[int, int, str, str | None]] = []
        for i, value in enumerate(values):
            sure, own = False, []
            for kind, words, left_out in readings(value):
                form = "".join(words)
                owners, inner = self.full.get(form, ()), self.core.get(form, ()) if kind in (BARE, ROTATED) else ()
                out += [(i, EXACT + kind, k, left_out) for k in owners] + [(i, EXACT + 10 + kind, k, left_out) for k in inner]
                sure = sure or bool(owners or inner) and left_out is None
                own.append((i, kind, form, left_out))
            for words, ident, edits in self.spelt_out(value):
                form = "".join(words)
                if ident in self.full.get(form, ()):
                    out.append((i, EDITED + 2 * edits + 1 if edits else EXACT + SPELT, ident, None))
                    sure = sure or not edits
                elif not edits:
                    own.append((i, SPELT, form, None))
            if not sure:
                asked += own
        near = {i for i, *_ in out}
        # a reading with a word left out has to be nearly exact, or words that merely share one with a name would do
        limits = [self.threshold(len(f)) if left is None else min(2, self.threshold(len(f))) for _, _, f, left in asked]
        measured: dict[tuple[str, str], int] = {}
        for at, d, name in self.names.within([f for _, _, f, _ in asked], limits):
            i, kind, form, left_out = asked[at]
            most = self.edits(len(form)) if left_out is None else 1
            edits = d if d <= 1 else measured.get((form, name))
            if edits is None:
                edits = measured[form, name] = transposed(form, name) if d <= 2 * most else d
            if edits <= most:
                near.add(i)
                price = EDITED + 2 * edits + (left_out is not None)
                out += [(i, price, k, left_out) for k in self.full.get(name, ())]
                out += [(i, price + 1, k, left_out) for k in self.core.get(name, ())]
        rest = [(i, f) for i, kind, f, left in asked if i not in near and left is None and len(f) >= 6]
        for at, d, begun in self.beginnings.within([f for _, f in rest], [2 if len(f) > 9 else 0 for _, f in rest]):
            i, form = rest[at]
            if (edits := d if d <= 1 else transposed(form, begun)) <= 1:
                out += [(i, BEGUN + 2 * edits, k, None) for k in self.begun[begun]]
        return out


_BUILT: dict[int, Matcher] = {}


def _matcher(names: list[tuple[int, str]]) -> Matcher:
    """The trees of a shard, built once a worker process; the last few shards are kept."""
    key = hash(tuple(names))
    if key not in _BUILT:
        while len(_BUILT) >= 2:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = Matcher(names)
    return _BUILT[key]


def map_values(values: DataFrame, reference: DataFrame, value_col: str, id_col: str, name_col: str, shard: int = SHARD) -> DataFrame:
    """(value, id) of each distinct value of ``values``; -1 where it renders no entry. ``shard`` changes no result."""
    spark = values.sparkSession
    # matching takes long for few bytes, so the number of tasks must not follow from their size; an exchange on the
    # value itself would be dropped as a repetition of the one for distinct
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = values.select(F.col(value_col).alias("value")).where("value IS NOT NULL").distinct().repartition(tasks, F.xxhash64("value"))
    named = reference.select(F.col(id_col).cast("bigint").alias("id"), F.col(name_col).alias("name")).where("id IS NOT NULL AND name IS NOT NULL")
    n_shards = max(1, -(-named.count() // shard))
    hits = None
    for k in range(n_shards):
        part = named.where(F.pmod(F.xxhash64("id"), F.lit(n_shards)) == k)
        shared = spark.sparkContext.broadcast(sorted((r[0], r[1]) for r in part.collect()))  # about ``shard`` names

        def match(batches: Iterator[pa.RecordBatch], shared=shared, first=not k) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value)
            for batch in batches:
                found = matcher.hits(batch.column("value").to_pylist())
                if first:  # every value has a row
                    found += [(i, NONE, -1, None) for i in range(batch.num_rows)]
                at, prices, idents, left = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column("value").take(pa.array(at, pa.int32())), pa.array(prices, pa.int32()), pa.array(idents, pa.int64()), pa.array(left, pa.string())], ["value", "price", "id", "left_out"])

        made = distinct.mapInArrow(match, "value string, price int, id bigint, left_out string")
        hits = made if hits is None else hits.unionByName(made)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for n in batch.column("name").to_pylist() for w in tokens(n)}), pa.string())], ["word"])

    known = named.select("name").mapInArrow(words, "word string").distinct()
    # an added word may be left out only if the list does not know it
    merged = hits.join(known, F.col("left_out") == F.col("word"), "left_anti")
    best = merged.groupBy("value").agg(F.min(F.struct("price", "id")).alias("a"), F.min(F.struct("price", -F.col("id"))).alias("b"))
    alone = F.col("a.id") == -F.col("b.col2")
    return best.select(F.col("value").alias(value_col), F.when(alone, F.col("a.id")).otherwise(F.lit(-1)).alias(id_col))


def review_values(judgments: DataFrame) -> DataFrame:
    """(judgment_id, field_name, raw_value): the distinct non-blank values of both review arrays."""
    part = lambda c: F.transform(F.coalesce(c, F.array()), lambda r: F.struct(r["selected_parent"].alias("p"), r["reward_categories"].alias("c")))
    reviews = judgments.select("judgment_id", F.explode(F.concat(part(F.col("chosen_step_reviews")), part(F.col("rejected_step_reviews")))).alias("r"))
    kinds = F.concat(F.array(F.struct(F.lit("selected_parent").alias("field_name"), F.col("r.p").alias("raw_value"))), F.transform(F.coalesce("r.c", F.array().cast("array<string>")), lambda x: F.struct(F.lit("reward_categories").alias("field_name"), x.alias("raw_value"))))
    values = reviews.select("judgment_id", F.explode(kinds).alias("v")).select("judgment_id", "v.field_name", "v.raw_value")
    return values.where(F.col("raw_value").rlike(r"[^\s\p{Z}\x{0085}\x{001C}-\x{001F}]")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = table(spark, sf_dir, "reward_criteria").select("criterion_id", "criterion_name")
    values = review_values(table(spark, sf_dir, "step_judgment"))
    names = criteria.select(F.col("criterion_name").alias("raw_value"))
    typed = values.join(names, "raw_value", "left_anti")
    mapped = map_values(typed, criteria, "raw_value", "criterion_id", "criterion_name")
    return typed.join(mapped, "raw_value").select("judgment_id", "field_name", "raw_value", "criterion_id")
