"""Numeric band join: for each item the totals over all lines with a near price, and the first few of them.

An item at p meets the lines at u with |u - p| <= absolute, or
denominator * |u - p| <= numerator * max(u, p): u is in an interval around p.

Lines are first added up for each u, and of each u the first lines are kept: at
most k of one item and 2k in all, which hold the first k of other items whichever
item asks.  So what follows is as large as the range of prices, not as the lines.

The us are shuffled by their high digits: a shard is as wide as the band at its
place, so that an interval touches a few shards at any price.  A task builds the
digit trie of its shard, whose nodes hold the sums of their subtrees, and answers
the distinct prices whose intervals touch it: totals by descents to the interval's
two ends and to p, first lines by a best-first walk in order of gap.  Answers are
added up by price, joined to the items, and rid of the item's own lines, whose
totals come from an equi-join on item and shard.

Nothing is broadcast or sent to the driver.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, lean_worker, select_columns

#: Amounts and prices of so many cents or more (or not finite) never pair: exact integers end about here.
MOST_CENTS = 9.0e15
_LINE = pa.struct([("gap", pa.int64()), ("u", pa.int64()), ("sale_id", pa.int64()), ("line_no", pa.int64()), ("line_item_id", pa.int64())])
_ANSWER = pa.schema([("p", pa.int64()), ("n", pa.int64()), ("gap_sum", pa.int64()), ("lines_crc", pa.int64()), ("lines", pa.list_(_LINE))])
_ANSWER_SQL = "p long, n long, gap_sum long, lines_crc long, lines array<struct<gap: long, u: long, sale_id: long, line_no: long, line_item_id: long>>"


def _floor_div(x: Column, by: Column) -> Column:
    """x / by rounded down, in exact integers; by is positive."""
    return F.call_function("div", x - F.pmod(x, by), by)


def cents(money: Column) -> Column:
    """floor(100 * x + 0.5) in doubles, as a long; null where x is null, not finite or too large."""
    raw = 100 * money.cast("double") + 0.5
    return F.when(F.abs(raw) < MOST_CENTS, F.floor(raw))


def unit_cents(a: Column, quantity: Column) -> Column:
    """floor((2 * a + quantity) / (2 * quantity)) for an amount of a cents, in exact integers; null for a quantity of 0."""
    q = F.when(quantity != 0, quantity.cast("long"))
    top = 2 * a + q
    return _floor_div(F.when(q < 0, -top).otherwise(top), 2 * F.abs(q))


class Band:
    """|u - p| <= absolute, or denominator * |u - p| <= numerator * max(u, p); the second less than 1."""

    def __init__(self, absolute: int = 100, numerator: int = 1, denominator: int = 1000) -> None:
        if absolute < 0 or not 0 <= numerator < denominator:
            raise ValueError("a band needs absolute >= 0 and 0 <= numerator < denominator")
        self.absolute, self.numerator, self.denominator = absolute, numerator, denominator
        # A shard keeps the high digits of u: it is 10**level wide, and no narrower than either band at its place.
        self._least = len(str(absolute - 1)) if absolute > 1 else 0
        self._kept = len(str(denominator // numerator)) - 1 if numerator else 18

    def low(self, p: Column) -> Column:
        return p - F.greatest(F.lit(self.absolute).cast("long"), _floor_div(p * self.numerator, F.lit(self.denominator).cast("long")))

    def high(self, p: Column) -> Column:
        # For u > p the second condition is (denominator - numerator) * u <= denominator * p.
        return p + F.greatest(F.lit(self.absolute).cast("long"), _floor_div(p * self.numerator, F.lit(self.denominator - self.numerator).cast("long")))

    def _width(self, u: Column) -> Column:
        level = F.greatest(F.length(F.abs(u).cast("string")) - self._kept, F.lit(self._least))
        return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(18)]), level + 1)

    def shard(self, u: Column) -> Column:
        """The shard of u, named by its first value."""
        return u - F.pmod(u, self._width(u))

    def shards(self, low: Column, high: Column) -> Column:
        """The shards that an interval touches: a few, for its width is of the order of theirs."""
        narrowest = F.when((low <= 0) & (high >= 0), F.lit(10**self._least).cast("long")).otherwise(F.least(self._width(low), self._width(high)))
        return F.array_distinct(F.transform(F.array_append(F.sequence(low, high, narrowest), high), self.shard))


class DigitTrie:
    """A trie over the decimal digits of us (less the least of them); a node holds count, sum of u and sum of CRCs of its subtree."""

    def __init__(self, leaves: list[tuple[int, int, int, list[tuple]]]) -> None:
        """leaves: (u, count, crc, first lines) with distinct us, at least one."""
        self.base = min(leaf[0] for leaf in leaves)
        self.depth = len(str(max(leaf[0] for leaf in leaves) - self.base))
        self.lines = {u: lines for u, _, _, lines in leaves}
        self.sums: dict[tuple[int, int], list[int]] = {}
        below: dict[tuple[int, int], set[int]] = {}
        for u, n, crc, _ in leaves:
            prefix = u - self.base
            for level in range(self.depth + 1):
                held = self.sums.setdefault((level, prefix), [0, 0, 0])
                held[0] += n
                held[1] += n * u
                held[2] += crc
                if level < self.depth:
                    below.setdefault((level + 1, prefix // 10), set()).add(prefix)
                    prefix //= 10
        self.children = {node: sorted(prefixes) for node, prefixes in below.items()}

    def before(self, u: int) -> tuple[int, int, int]:
        """count, sum of u and of CRCs of all lines below u: one descent along u's digits, adding what branches off to the left."""
        place = u - self.base
        if place <= 0:
            return 0, 0, 0
        if place >= 10**self.depth:
            return tuple(self.sums[self.depth, 0])
        n = total = crc = 0
        for level in range(self.depth - 1, -1, -1):
            digit = place // 10**level
            for child in self.children.get((level + 1, digit // 10), ()):
                if child >= digit:
                    break
                held = self.sums[level, child]
                n, total, crc = n + held[0], total + held[1], crc + held[2]
        return n, total, crc

    def totals(self, low: int, p: int, high: int) -> tuple[int, int, int]:
        """count, sum of gaps to p and sum of CRCs of the lines in low..high."""
        a, b, c = self.before(low), self.before(p), self.before(high + 1)
        left, right = b[0] - a[0], c[0] - b[0]
        return left + right, (p * left - (b[1] - a[1])) + ((c[1] - b[1]) - p * right), c[2] - a[2]

    def nearest(self, low: int, p: int, high: int) -> Iterator[int]:
        """The us in low..high by gap to p, then u: best first, opening a node only when nothing nearer is left."""
        queue: list[tuple[int, int, int, int]] = []

        def offer(level: int, prefix: int) -> None:
            first = self.base + prefix * 10**level
            last = first + 10**level - 1
            if last >= low and first <= high:
                near = min(max(p, first), last)
                # The least gap that the subtree can have; at one gap and u the inner node is opened before its leaf.
                heapq.heappush(queue, (abs(near - p), near, -level, prefix))

        offer(self.depth, 0)
        while queue:
            _, near, level, prefix = heapq.heappop(queue)
            if level == 0:
                yield near
                continue
            for child in self.children[-level, prefix]:
                offer(-level - 1, child)

    def first_lines(self, low: int, p: int, high: int, k: int) -> list[tuple]:
        """(gap, u, sale_id, line_no, line_item_id) in order: at most k of an item and 2k in all, so the first k whichever item is left out."""
        found, of = [], Counter()
        for u in self.nearest(low, p, high):
            for line in self.lines[u]:
                if of[line[2]] < k:
                    of[line[2]] += 1
                    found.append((abs(u - p), u, *line))
                    if len(found) == 2 * k:
                        return found
        return found


def _answers(k: int):  # noqa: ANN202
    def run(leaves: pa.Table, prices: pa.Table) -> pa.Table:
        lean_worker()
        rows = []
        if leaves.num_rows and prices.num_rows:
            trie = DigitTrie([(x["u"], x["n"], x["crc"], [(y["sale_id"], y["line_no"], y["item_id"]) for y in x["lines"]]) for x in leaves.to_pylist()])
            for x in prices.to_pylist():
                p, low, high = x["p"], x["low"], x["high"]
                n, gap_sum, crc = trie.totals(low, p, high)
                if n:
                    names = ("gap", "u", "sale_id", "line_no", "line_item_id")
                    rows.append({"p": p, "n": n, "gap_sum": gap_sum, "lines_crc": crc, "lines": [dict(zip(names, y, strict=True)) for y in trie.first_lines(low, p, high, k)]})
        return pa.Table.from_pylist(rows, _ANSWER)

    return run


def _first_lines(lines: DataFrame, k: int) -> DataFrame:
    """u, lines: of each u at most k lines of an item and 2k in all, in order.  Both ranks are cut before they are shuffled, too."""
    order = ["sale_id", F.col("line_no").asc_nulls_first()]
    turn = F.row_number().over(Window.partitionBy("u", "item_id").orderBy(*order))
    few = lines.withColumn("turn", turn).where(F.col("turn") <= k)
    turn = F.row_number().over(Window.partitionBy("u").orderBy(*order, "item_id"))
    few = few.withColumn("turn", turn).where(F.col("turn") <= 2 * k)
    return few.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("sale_id", "line_no", "item_id"))).alias("lines"))


def band_join(lines: DataFrame, items: DataFrame, band: Band | None = None, k: int = 2) -> DataFrame:
    """Each item's first k pairs by (gap, u, sale_id, line_no, line_item_id), and over all its pairs n_pairs, gap_sum, lines_crc.

    lines(sale_id, line_no, item_id, quantity, amount), items(item_id, price); other columns are ignored.
    Columns: item_id, rank (from 1), gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc, the sum
    of unsigned CRC32 of `sale_id,line_no,line_item_id`.  An item without pairs has one row of rank 0, null
    lines and three zeros.

    Lines null in sale_id, item_id, quantity or amount, of quantity 0, or of an amount that is not finite
    or of 9e15 cents or more never pair, nor do items with such a price, or without an id (no line is
    known to be another's).  A null line_no is empty text in the CRC and sorts first.  Repeated lines
    each count and take a rank each; repeated items have their rows each.  Empty tables give no pairs
    or no rows.
    """
    band = band or Band()
    raw = select_columns(lines, "sale_id", "line_no", "item_id", "quantity", "amount").select(F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"), F.col("item_id").cast("long").alias("item_id"), unit_cents(cents(F.col("amount")), F.col("quantity")).alias("u"))
    raw = raw.where("sale_id IS NOT NULL AND item_id IS NOT NULL AND u IS NOT NULL")
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    # Of each item and u, then of each u: both are added up before they are shuffled.  Written, as both sums and own totals read it.
    own = checkpointed(raw.select("item_id", "u", F.crc32(text.cast("binary")).alias("crc")).groupBy("item_id", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("crc")))
    leaves = own.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc")).join(_first_lines(raw, k), "u").withColumn("shard", band.shard(F.col("u")))

    priced = select_columns(items, "item_id", "price").select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price")).alias("p")).groupBy("item_id", "p").agg(F.count(F.lit(1)).alias("copies"))
    asked = priced.where("item_id IS NOT NULL AND p IS NOT NULL")
    touched = F.explode(band.shards(band.low(F.col("p")), band.high(F.col("p")))).alias("shard")
    prices = asked.select("p").distinct().select("p", band.low(F.col("p")).alias("low"), band.high(F.col("p")).alias("high"), touched)
    answers = leaves.groupBy("shard").cogroup(prices.groupBy("shard")).applyInArrow(_answers(k), _ANSWER_SQL)
    # Written, so that a price that many items share is split where it meets them.
    answers = checkpointed(answers.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gap_sum").alias("gap_sum"), F.sum("lines_crc").alias("lines_crc"), F.flatten(F.collect_list("lines")).alias("lines")))

    mine = own.select(F.col("item_id").alias("own_id"), "u", "n", "crc", band.shard(F.col("u")).alias("own_shard"))
    near = asked.select("item_id", "p", touched).join(mine, (F.col("item_id") == F.col("own_id")) & (F.col("shard") == F.col("own_shard")) & F.col("u").between(band.low(F.col("p")), band.high(F.col("p"))))
    near = near.groupBy("item_id", "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * F.abs(F.col("u") - F.col("p"))).alias("own_gap"), F.sum("crc").alias("own_crc"))

    less = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    first = F.slice(F.sort_array(F.filter("lines", lambda x: x["line_item_id"] != F.col("item_id"))), 1, k)
    full = asked.join(answers, "p", "left").join(near, ["item_id", "p"], "left").select("item_id", "copies", less("n", "own_n").alias("n_pairs"), less("gap_sum", "own_gap").alias("gap_sum"), less("lines_crc", "own_crc").alias("lines_crc"), first.alias("first"))
    zero = F.lit(0).cast("long")
    bare = priced.where("item_id IS NULL OR p IS NULL").select("item_id", "copies", zero.alias("n_pairs"), zero.alias("gap_sum"), zero.alias("lines_crc"), F.lit(None).cast(full.schema["first"].dataType).alias("first"))
    rows = full.unionByName(bare).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("*", F.posexplode_outer("first").alias("place", "line"))
    return rows.select("item_id", F.coalesce(F.col("place") + 1, F.lit(0)).cast("int").alias("rank"), "line.*", "n_pairs", "gap_sum", "lines_crc")
