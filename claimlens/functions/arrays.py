"""Array expressions for row-local sequential work (no UDFs, no shuffle)."""

from pyspark.sql import functions as F

_PIECES = "array<struct<s:int,e:int>>"


def let(value, body):
    """Evaluate ``value`` once and use it in ``body`` (lambdas re-evaluate their inputs)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def indexes(arr):
    """0-based positions of an array; empty for an empty array."""
    return F.when(F.size(arr) > 0, F.sequence(F.lit(0), F.size(arr) - 1)).otherwise(
        F.array().cast("array<int>"))


def at(arr, i):
    """Element at a 0-based position, NULL outside."""
    return F.try_element_at(arr, i + 1)


def between(arr, start, end):
    """Elements start..end-1 (0-based), taken one by one."""
    return F.transform(
        F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>")), lambda i: at(arr, i))


def _tail_that_fits(lens, start, end, budget):
    """(count, sum) of the longest tail of lens[start:end] whose sum stays within the budget.

    Stops at the first length that does not fit, reading backwards.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"), F.lit(False).alias("stop"))
    return F.aggregate(
        F.reverse(between(lens, start, end)), zero,
        lambda a, x: F.when(a["stop"] | (a["sum"] + x > budget),
                            F.struct(a["n"].alias("n"), a["sum"].alias("sum"), F.lit(True).alias("stop")))
        .otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + x).alias("sum"), F.lit(False).alias("stop"))),
    )


def pack(lens, limit, overlap=None, glue=0):
    """Greedy packing of consecutive lengths into pieces [s, e).

    A piece is closed when the next length would take it over the limit; a single
    length over the limit stays whole. ``glue`` is added per packed element. With
    an ``overlap`` budget the next piece starts with the tail of the last one that
    fits the budget. One pass over the array. Steps of a fold that carry all pieces take
    time that grows with them (measured), so the pieces are gathered by stretches of about the square root of the length: the
    state of the steps holds two numbers and one stretch's pieces, and only the few
    steps from stretch to stretch carry all pieces.
    """
    n_all = F.size(lens)
    stride = F.ceil(F.sqrt(n_all)).cast("int")
    empty = F.array().cast(_PIECES)

    def step(a, i):
        n = at(lens, i)
        close = (i > a["s"]) & (a["cur"] + n > limit)
        pieces = F.array_append(a["p"], F.struct(a["s"].alias("s"), i.alias("e")))
        if overlap is None:
            cut = F.struct(i.alias("s"), (n + glue).alias("cur"), pieces.alias("p"))
        else:
            cut = let(_tail_that_fits(lens, a["s"], i, overlap), lambda t: F.struct(
                (i - t["n"]).alias("s"), (t["sum"] + n).alias("cur"), pieces.alias("p")))
        keep = F.struct(a["s"].alias("s"), (a["cur"] + n + glue).alias("cur"), a["p"].alias("p"))
        return F.when(close, cut).otherwise(keep)

    def stretch(a, b):
        open_ = F.struct(a["s"].alias("s"), a["cur"].alias("cur"), empty.alias("p"))
        done = F.aggregate(F.sequence(b, F.least(b + stride, n_all) - 1), open_, step)
        return let(done, lambda r: F.struct(
            r["s"].alias("s"), r["cur"].alias("cur"), F.array_append(a["runs"], r["p"]).alias("runs")))

    def finish(a):
        rest = F.when(n_all > a["s"], F.array(F.struct(a["s"].alias("s"), n_all.alias("e")))).otherwise(empty)
        return F.flatten(F.array_append(a["runs"], rest))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("cur"), F.array().cast(f"array<{_PIECES}>").alias("runs"))
    firsts = F.when(n_all > 0, F.sequence(F.lit(0), n_all - 1, stride)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, start, stretch, finish)


def occurrence(keys):
    """For every element, how many equal ones stand before it (nulls are equal). Positions are sorted: n log n."""
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

    def ranks(rows):
        new = lambda j: (j == 0) | ~at(rows, j)["k"].eqNullSafe(at(rows, j - 1)["k"])
        return let(F.filter(indexes(rows), new), lambda starts: F.flatten(F.transform(starts, lambda s, r: F.transform(
            between(rows, s, F.coalesce(at(starts, r + 1), F.size(rows))),
            lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))))))

    return F.transform(F.array_sort(let(placed, ranks)), lambda x: x["n"])


def split_with_overlap(text, limit, overlap, sep="\n\n"):
    """Paragraph packing of a text into pieces of about ``limit`` characters."""
    def cut(paras):
        return let(F.transform(paras, lambda p: F.length(p)), lambda lens: F.transform(
            pack(lens, limit, overlap), lambda q: F.array_join(between(paras, q["s"], q["e"]), sep)))

    return let(text, lambda t: F.when(F.length(t) <= limit, F.array(t)).otherwise(
        let(F.split(t, sep), cut)))
