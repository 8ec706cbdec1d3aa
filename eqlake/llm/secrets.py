"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger
is a table of (blob, rule, version) that were scanned and of what was found; a scan
takes only the pairs that the ledger doesn't have, and findings are joined back
to every path that has the blob. Moving, copying or reverting a file costs
nothing, and a new rule version costs one scan of each blob by that rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import attach, unused, written


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` of a match needs ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


#: Base kinds in the order in which equal starts are listed: fixed values.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: A line break, also one written as \\n, with what stands before it and a quote's or indent's start after it.
_BREAK = r"""[ \t]*+["']?(?:\r\n?|\n|(?:\\r)?\\n)[ \t>"']*+"""
#: A line of base64 and nothing else.
_BASE64 = r"""[A-Za-z0-9+/]++={0,2}(?=[ \t]*+(?:["'`,;\r\n\\]|\z))"""
#: A private key from its header to the footer of the same name with no other header or footer between; without such a footer
#: its header lines and the base64 lines that follow, or base64 in one line. Possessive, so that long bodies don't fill the stack.
_PEM = (
    r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Z][A-Za-z0-9-]*+: [^\r\n\\]*+)*+(?:{_BREAK}){{1,2}}{_BASE64}(?:{_BREAK}{_BASE64})*+"
    r"|(?:[ \t]*+[A-Za-z0-9+/]{40,}+={0,2})++(?:[ \t]++(?:[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]++={1,2}))?+)?+"
)
#: Further kinds of public key and token formats.
RULES = BASE + (
    Rule("pem", 2, _PEM, 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    Rule("hub", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)


def matches(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end, kind, rank>>`` of the rule's matches, leftmost first, not overlapping.

    The stretches between matches and the matches alternate, so their lengths
    give each match's place in code points.
    """
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,long:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["b"])
        end = begin + F.char_length(x["w"])
        return F.struct(
            end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), F.char_length(x["c"]).alias("long")))).alias("out")
        )

    # the last stretch has no match after it
    pairs = F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda b, w: F.struct(b.alias("b"), w.alias("w")))
    named = F.zip_with(pairs, checked, lambda z, c: F.struct(z["b"].alias("b"), z["w"].alias("w"), c.alias("c")))
    found = F.aggregate(named, start, step)["out"]
    good = F.filter(found, lambda m: m["long"] >= rule.least)
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


FOUND = "array<struct<start:bigint,end:bigint>>"


def blobs(versions: DataFrame, name: str = "_blob") -> DataFrame:
    """``versions`` with the address of each text's content; a null text is the empty one."""
    return versions.withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256))


class Ledger:
    """Scanned pairs and findings: ``blob, rule, version, spans``, a row with no spans for a clean pair.

    ``table`` is None at first, or what an earlier ``scan`` made; ``save`` and
    ``load`` keep it between jobs.
    """

    def __init__(self, table: DataFrame | None = None):
        self.table = table

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ledger:
        return cls(spark.read.parquet(path))

    def save(self, path: str) -> None:
        """Into an empty path; a later job loads it, scans and saves to the next one."""
        self.table.write.parquet(path)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> Ledger:
        """The ledger with every (blob, rule, version) of ``versions`` (``path``, ``text``) added that it doesn't have.

        Of each unseen blob one path's text is read. Addresses and least paths
        are grouped first, so copies never travel with their text.
        """
        addressed = blobs(versions.select("path", "text"))
        wanted = addressed.groupBy("_blob").agg(F.min("path").alias("one"))
        todo = wanted.select("_blob", "one", F.array(*(F.lit(r.name) for r in rules)).alias("rules"))
        if self.table is not None:
            current = None
            for r in rules:
                own = (F.col("rule") == r.name) & (F.col("version") == r.version)
                current = own if current is None else current | own
            seen = self.table.where(current).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
            todo = wanted.join(seen, F.col("_blob") == F.col("blob"), "left").select(
                "_blob", "one", F.array_except(F.array(*(F.lit(r.name) for r in rules)), F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")
            )
            todo = todo.where(F.size("rules") > 0)
        todo = todo.withColumnsRenamed({"_blob": "blob"})
        unseen = addressed.join(todo, (F.col("path").eqNullSafe(F.col("one"))) & (F.col("_blob") == F.col("blob"))).select("blob", "rules", F.coalesce("text", F.lit("")).alias("text"))
        none = F.array().cast(FOUND)
        each = [
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.version).alias("version"),
                # a plain test comes first; most texts have no match
                F.when(F.array_contains("rules", r.name) & F.col("text").rlike(r.pattern), matches(F.col("text"), r)).otherwise(none).cast(FOUND).alias("spans"),
            )
            for r in rules
        ]
        # one row a blob while it is scanned; clean pairs stay one row a blob
        scanned = unseen.select("blob", "rules", F.array(*each).alias("found"))
        new = scanned.select("blob", F.filter("found", lambda x: F.array_contains(F.col("rules"), x["rule"])).alias("found"))
        new = new.dropDuplicates(["blob"]).select("blob", F.inline("found"))
        new = written(new, "ledger")
        return Ledger(new if self.table is None else self.table.unionByName(new))

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, spans`` of blobs in which the rules' current versions found something; spans by start, then in rule order."""
        rank = F.element_at(F.create_map(*(x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k)))), F.col("rule"))
        rows = self.table.where(F.size("spans") > 0).withColumn("rank", rank).where(F.col("rank").isNotNull())
        current = F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.version)))), F.col("rule"))
        rows = rows.where(F.col("version") == current)
        listed = rows.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind"))))
        return listed.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))


SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def with_findings(documents: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``documents`` with what was found in the blob of each row, an empty array where nothing was, and that column's name.

    Blobs with findings are counted; few are broadcast, so that no text moves,
    and many are joined by salted addresses, so that a mass of copies isn't one task.
    """
    blob, spans = unused(documents.columns, "_blob", "_spans")
    found = written(ledger.findings(rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "findings")
    rows = attach(blobs(documents, blob), found, blob).drop(blob)
    return rows.withColumn(spans, F.coalesce(spans, F.array().cast(SPANS))), spans


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(documents: DataFrame, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Spans are in code points, end exclusive, as kind:start:end. A null or
    empty text has none. Paths are doc_ids; a row without one is scanned like
    others. Repeated rows repeat, and an empty table gives an empty one.
    """
    ledger = (ledger or Ledger()).scan(documents.select(F.col("doc_id").alias("path"), "text"), rules)
    rows, spans = with_findings(documents.select("doc_id", "text"), ledger, rules)
    base = F.filter(spans, lambda s: s["kind"].isin([r.name for r in BASE]))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(r.name) for r in BASE), F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col(spans)).alias("spans"))


def redacted(documents: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``documents`` with every span of a secret replaced by ``mask``; overlapping spans count as one, and ``n_chars`` follows."""
    ledger = Ledger().scan(documents.select(F.col("doc_id").alias("path"), "text"))
    rows, spans = with_findings(documents, ledger)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        plain = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], plain, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    text = F.when(F.size(spans) > 0, done).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*documents.columns)
