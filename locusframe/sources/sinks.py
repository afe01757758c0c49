"""VCF text from the variants DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.genotypes import let
from . import blocked, csi
from .header import UNDECLARED, Header


def g_text(x: Column) -> Column:
    """C's %g of a number, by built-in functions: six digits, exact ties to even, trailing zeros cut; null for NaN and null."""
    d = F.abs(x.cast("double"))
    sign = F.when(F.startswith(x.cast("double").cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    zero = F.lit("0")
    formats = F.struct(*[F.call_function("format_number", d, F.lit(p)).alias(n) for n, p in (("six", "0.#####E0"), ("seven", "0.######E0"))])

    def rounded(f: Column) -> Column:
        """struct(digits, power): Java takes some exact ties for none. A value is one if its seven digits end in 5 and it is
        a whole number of halves, quarters ..."""
        (short, power6), (longer, power7) = ((F.replace(F.substring_index(f[n], "E", 1), F.lit("."), F.lit("")), F.substring_index(f[n], "E", -1).cast("int")) for n in ("six", "seven"))
        scaled = d * F.pow(F.lit(2.0), F.greatest(F.lit(6) - power7, F.lit(0)))
        tie = (F.length(longer) == 7) & F.endswith(longer, F.lit("5")) & (scaled == F.floor(scaled)) & (F.concat(longer, F.lit("e"), (power7 - 6).cast("string")).cast("double") == d)
        even = F.bround(longer.cast("bigint"), -1).cast("string")
        carried = F.struct(F.rtrim(even, zero).alias("digits"), (power7 + F.length(even) - 7).alias("power"))
        return F.when(tie, carried).otherwise(F.struct(short.alias("digits"), power6.alias("power")))

    def spelled(r: Column) -> Column:
        digits, power = r["digits"], r["power"]
        whole = F.rpad(digits, F.greatest(power + 1, F.length(digits)), zero)
        plain = F.when(power < 0, F.concat(F.lit("0."), F.repeat(zero, -power - 1), digits)).when(F.length(whole) <= power + 1, whole)
        plain = plain.otherwise(F.concat(F.substring(whole, F.lit(1), power + 1), F.lit("."), F.substring(whole, power + 2, F.lit(16))))
        mantissa = F.when(F.length(digits) > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 5))).otherwise(digits)
        size = F.abs(power).cast("string")
        far = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(size, F.greatest(F.lit(2), F.length(size)), zero))
        return F.when(power.between(-4, 5), plain).otherwise(far)

    text = (
        F.when((d < 1e6) & (d == F.floor(d)), d.cast("bigint").cast("string"))
        .when((d < 1e4) & (d * 4 == F.floor(d * 4)), F.rtrim(d.cast("decimal(8,2)").cast("string"), zero))
        .otherwise(let(let(formats, rounded), spelled))
    )
    return F.when(F.isnan(d), None).when(d == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.concat(sign, text))


def _each(one: Callable[[Column], Column], c: Column) -> Column:
    return F.transform(c, lambda x: one(x))


def _texts(c: Column, kind: T.DataType) -> Column:
    """A value, or list of values, with numbers as text; structure and nulls stay."""
    leaf, depth = kind, 0
    while isinstance(leaf, T.ArrayType):
        leaf, depth = leaf.elementType, depth + 1
    if isinstance(leaf, T.FloatType | T.DoubleType):
        text = partial(let, body=g_text)
        for _ in range(depth):
            text = partial(_each, text)
        return text(c)
    return c.cast(kind.simpleString().replace(leaf.simpleString(), "string"))


def _joined(c: Column, lists: bool) -> Column:
    """Comma-joined, a dot for what is missing."""
    dot = F.lit(".")
    if not lists:
        return F.coalesce(c, dot)
    return F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.coalesce(x, dot)), ",")).otherwise(dot)


def _gt_text(g: Column) -> Column:
    number = lambda x: F.when(x < 0, F.lit(".")).otherwise(x.cast("string"))
    parts = F.transform(g["a"], lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(F.get(g["p"], i), F.lit("|")).otherwise(F.lit("/")), number(x)))
    return F.array_join(parts, "")


def vcf_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Add the VCF line of each row. INFO and FORMAT follow info_keys and format_keys; keys without a value print none."""
    names = df.columns
    # numbers become text once for each row: what is bound by ``let`` is not evaluated again for every key or sample
    kinds: dict[str, dict[str, tuple[str, bool]]] = {"info": {}, "fmt": {}}
    texts: dict[str, list[Column]] = {"info": [], "fmt": []}
    for struct in ("info", "fmt"):
        for i, f in enumerate(df.schema[struct].dataType.fields if struct in names else []):
            lists = isinstance(f.dataType, T.ArrayType) if struct == "info" else isinstance(f.dataType.elementType, T.ArrayType)
            kinds[struct][f.name] = (f"v{i}", lists)
            c = F.col(f"{struct}.`{f.name}`")
            texts[struct].append((c.cast("string") if isinstance(f.dataType, T.BooleanType) else _texts(c, f.dataType)).alias(f"v{i}"))
    bound = {k: F.struct(*v) if v else F.struct(F.lit(0).alias("none")) for k, v in texts.items()}
    flags = {f.name for f in df.schema["info"].dataType.fields if isinstance(f.dataType, T.BooleanType)} if "info" in names else set()

    def info_one(t: Column, k: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for n, (c, lists) in kinds["info"].items():
            text = F.lit(n) if n in flags else F.when(t[c].isNull(), F.lit(n + "=.")).otherwise(F.concat(F.lit(n + "="), _joined(t[c], lists)))
            out = out.when(k == n, text)
        return out.otherwise(k)

    info = let(bound["info"], lambda t: F.array_join(F.transform("info_keys", lambda k: info_one(t, k)), ";")) if "info_keys" in names else F.lit(".")
    info = F.coalesce(F.when(F.length(info) > 0, info), F.lit("."))
    dot = F.lit(".")
    head = [F.col("contig"), F.col("pos").cast("string"), F.coalesce("id", dot), F.get("alleles", F.lit(0)), F.coalesce(F.when(F.size("alleles") > 1, F.array_join(F.slice("alleles", 2, F.greatest(F.size("alleles") - 1, F.lit(1))), ",")), dot)]
    head += [F.coalesce(let(F.col("qual"), g_text), dot), F.coalesce(F.when(F.size("filters") > 0, F.array_join("filters", ";")), dot), info]
    line = F.concat_ws("\t", *head)
    if "format_keys" in names and ("gt" in names or kinds["fmt"]):
        arrays = [*([F.col("gt")] if "gt" in names else []), *[F.col(f"fmt.`{n}`") for n in kinds["fmt"]]]
        n_samples = F.greatest(*[F.coalesce(F.size(c), F.lit(-1)) for c in arrays], F.lit(-1))

        def sample(t: Column, i: Column) -> Column:
            def one(k: Column) -> Column:
                out = F.when(k == "GT", F.coalesce(_gt_text(F.get("gt", i)), dot)) if "gt" in names else F.when(F.lit(False), dot)
                for n, (c, lists) in kinds["fmt"].items():
                    out = out.when(k == n, F.coalesce(_joined(F.get(t[c], i), lists), dot))
                return out.otherwise(dot)

            return F.array_join(F.transform("format_keys", one), ":")

        every = let(bound["fmt"], lambda t: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n_samples, F.lit(1)) - 1), lambda i: sample(t, i)), "\t"))
        some = F.coalesce(F.size("format_keys") > 0, F.lit(False)) & (n_samples > 0)
        line = F.when(some, F.concat_ws("\t", line, F.array_join("format_keys", ":"), every)).otherwise(line)
    return df.withColumn(value, line)


def _order(header: Header) -> Column:
    """Contigs in the order of the header, others after them."""
    if not header.contigs:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(header.contigs) for x in (c, i)]), F.col("contig")), F.lit(len(header.contigs)))


def _sorted(df: DataFrame, header: Header) -> DataFrame:
    return vcf_lines(df).select(_order(header).alias("o"), "contig", "pos", F.lit(0).alias("n"), "value")


def _depth(header: Header) -> int:
    """Levels of an index over the declared contigs; one that is not declared may have any length."""
    return csi.depth_for(max(header.contigs.values(), default=UNDECLARED))


def write_vcf(df: DataFrame, header: Header, path: str, compression: str | None = None, with_header: bool = True, genotypes: bool = True, index: bool = False) -> None:
    """Text files under path whose parts in order make one VCF: header first, then rows by contig and position.

    The rows are sorted by range, so that no file or task holds them all. compression: ``gzip`` writes plain gzip,
    ``bgzf`` the blocked kind, with a CSI index beside each file where ``index`` asks for it.
    """
    if not genotypes:
        df = df.drop("gt", "fmt", "format_keys")
    rows = _sorted(df, header)
    if with_header:
        head = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(header.text(genotypes))], "n int, value string")
        rows = head.select(F.lit(-1).alias("o"), F.lit("").alias("contig"), F.lit(0).cast("bigint").alias("pos"), "n", "value").unionByName(rows)
    out = rows.orderBy("o", "contig", "pos", "n", "value").select("value")
    if compression == "bgzf":
        blocked.write_parts(out, path, ".vcf.gz", blocked.text_lines, _depth(header) if index else None)
    else:
        (out.write.option("compression", compression) if compression else out.write).text(path)


def write_bcf(df: DataFrame, header: Header, path: str, genotypes: bool = True, index: bool = False) -> None:
    """BCF 2 files under path, one for each task, each with the header, and with a CSI index beside it if asked: rows by contig
    and position over all of them."""
    if not genotypes:
        df = df.drop("gt", "fmt", "format_keys")
    # a sort looks at a sample of its rows first: dealt out before, the lines are not made a second time for it
    rows = _sorted(df, header).repartition("contig", "pos", "value").orderBy("o", "contig", "pos", "n", "value").select("value")
    numbered = blocked.dictionaries(header.text(genotypes))[1]
    contigs = [numbered.get(i, "") for i in range(max(numbered, default=-1) + 1)]
    blocked.write_parts(rows, path, ".bcf", blocked.bcf_records(header, genotypes), _depth(header) if index else None, contigs)
