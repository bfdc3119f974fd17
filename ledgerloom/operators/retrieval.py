"""Full-text retrieval: positional postings, BM25, composition of ranked answers, recall, evaluation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.errors import QueryError
from ledgerloom.functions import text as X
from ledgerloom.operators import filters
from ledgerloom.shared import cut

CANDIDATES, RECENT, PER_SESSION, MOST_LIMIT = 300, 50, 2, 30
MOST_WORDS, MOST_PHRASES, MOST_PARTS, LEAST_DF_EVENTS = 16, 8, 12, 1000
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Query:
    """Words and phrases to be OR-ed; a phrase is a tuple of index tokens."""

    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]

    @property
    def elements(self) -> list[tuple[str, ...]]:
        return list(dict.fromkeys([tuple(_parts(w)) for w in self.words] + list(self.phrases)))


def _plain(s: str) -> str:
    return s.lower().translate(X.FOLDED)


def _parts(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", _plain(s))


def parse(text: str, drop: frozenset[str] | None = None) -> Query:
    """Quoted phrases, words of 2 to 100 characters, and for identifiers with . / : \\ - also the phrase of their parts."""
    drop = frozenset(X.STOPWORDS) if drop is None else drop
    phrases, words = [], []
    for quoted in re.findall(r'"([^"]*)"', text):
        parts = _parts(quoted)[:MOST_PARTS]
        if len(parts) > 1:
            phrases.append(tuple(parts))
        else:
            words += parts
    for ident in re.findall(r"\w+(?:[./\\:-]+\w+)*", re.sub(r'"[^"]*"', " ", text)):
        found = re.findall(r"\w+", ident)
        words += [w.lower() for w in found]
        if len(found) > 1:
            phrases.append(tuple(_parts(ident)[:MOST_PARTS]))
    words = [w for w in dict.fromkeys(words) if 2 <= len(w) <= 100 and w not in drop and _parts(w)]
    return Query(tuple(words[:MOST_WORDS]), tuple(dict.fromkeys(p for p in phrases if p))[:MOST_PHRASES])


def postings(event: DataFrame) -> DataFrame:
    """(id, len, pos, term): one row per token, each with the length of its document. The derived index; hash it by term to serve many queries."""
    return _positions(event.select("id", X.tokens(F.col("text")).alias("_t")))


def _positions(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.size("_t").alias("len"), F.posexplode("_t").alias("pos", "term"))


def lengths(event: DataFrame) -> DataFrame:
    return event.select("id", F.size(X.tokens(F.col("text"))).alias("len"))


LEAST_BUCKETS, MOST_BUCKETS, FILE_POSTINGS, MOST_SEGMENTS = 64, 4_096, 4_000_000, 16
SEGMENT = "segment int, base boolean, buckets int, docs long, tokens long, gone long"


@dataclass(frozen=True)
class Index:
    """A written index: postings by a hash of their term, each with its document's length, and the totals. A search reads the buckets of its terms and tokenises nothing.

    The folder holds segments. Each has postings, a row (id, len, digest) per document and the ids it takes out of earlier segments;
    its marker, written last, makes them count together, so that a job that dies leaves the index as it was and repeats under the same number.
    Events need an id; one without is not indexed, one without text has no tokens but counts as a document.
    """

    postings: DataFrame
    documents: DataFrame
    totals: DataFrame
    buckets: int

    @staticmethod
    def bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    @staticmethod
    def write(event: DataFrame, folder: str) -> None:
        """A new index of these events, in place of what the folder held."""
        Index._add(event.sparkSession, folder, event, None)

    @staticmethod
    def sync(event: DataFrame, folder: str) -> int:
        """Brings the index to these events, as after a pass that added some and an erasure that took others: how many were added, changed or removed.

        New and changed events become a segment, removed and changed ones are taken out of earlier ones. Ids and digests alone are compared. After
        MOST_SEGMENTS segments all are written as one; readers that were opened before must be opened again.
        """
        spark = event.sparkSession
        live = Index._live(spark, folder)
        if not live:
            Index.write(event, folder)
            return event.where("id is not null").count()
        old = Index._standing(spark, folder, live, "docs", "id long, len int, digest long").select("id", F.col("digest").alias("_old"))
        now = event.where("id is not null").select("id", F.xxhash64("text").alias("_now"))
        changed = cut(old.join(now, "id", "full").where(~F.col("_old").eqNullSafe(F.col("_now"))))
        n = changed.count()
        if n and len(live) >= MOST_SEGMENTS:
            Index.write(event, folder)
        elif n:
            Index._add(spark, folder, event.join(changed.where("_now is not null").select("id"), "id", "left_semi"), changed.where("_old is not null").select("id"))
        return n

    @staticmethod
    def _add(spark: SparkSession, folder: str, event: DataFrame, gone: DataFrame | None) -> None:
        """A segment of these events: the first of a new index, or one that takes the ids of gone out of those before it."""
        known = Index._markers(spark, folder)
        live = [] if gone is None else Index._live(spark, folder)
        k = 1 + max((m["segment"] for m in known), default=-1)
        at = lambda part: f"{folder}/{part}/segment={k}"
        event = event.where("id is not null")
        # tokenised once: the lengths, the bounds of the ranges and the postings start from these rows
        event.select("id", X.tokens(F.col("text")).alias("_t"), F.xxhash64("text").alias("digest")).write.mode("overwrite").parquet(at("tokens"))
        tokenised = spark.read.schema("id long, _t array<string>, digest long").parquet(at("tokens"))
        tokenised.select("id", F.size("_t").alias("len"), "digest").write.mode("overwrite").parquet(at("docs"))
        sums = lambda docs: docs.agg(F.count("*"), F.coalesce(F.sum(F.greatest("len", F.lit(0))), F.lit(0))).first()
        docs, tokens = sums(spark.read.schema("id long, len int, digest long").parquet(at("docs")))
        less = (0, 0)
        if gone is not None:
            gone.write.mode("overwrite").parquet(at("gone"))
            before = Index._standing(spark, folder, live, "docs", "id long, len int, digest long")
            less = sums(before.join(spark.read.schema("id long").parquet(at("gone")), "id", "left_semi"))
        buckets = live[-1]["buckets"] if live else min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (tokens // FILE_POSTINGS).bit_length()))
        rows = _positions(tokenised).withColumn("bucket", Index.bucket(F.col("term"), buckets))
        # ranges of about as many postings each: a term that a third of all rows hold is dealt over many files
        dealt = rows.repartitionByRange(max(1, -(-tokens // FILE_POSTINGS)), "bucket", "term", "id")
        dealt.sortWithinPartitions("bucket", "term", "id", "pos").write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
        path = spark._jvm.org.apache.hadoop.fs.Path(at("tokens"))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        marker = spark.createDataFrame([(gone is None, buckets, docs - less[0], tokens - less[1], less[0])], SEGMENT.split(", ", 1)[1])
        marker.coalesce(1).write.mode("overwrite").parquet(at("segments"))

    @staticmethod
    def _markers(spark: SparkSession, folder: str) -> list[Row]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/segments")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return spark.read.schema(SEGMENT).parquet(f"{folder}/segments").orderBy("segment").collect()  # a row per segment

    @staticmethod
    def _live(spark: SparkSession, folder: str) -> list[Row]:
        """Segments from the last whole one on, at most MOST_SEGMENTS."""
        known = Index._markers(spark, folder)
        first = max((m["segment"] for m in known if m["base"]), default=0)
        return [m for m in known if m["segment"] >= first]

    @staticmethod
    def _standing(spark: SparkSession, folder: str, live: list[Row], part: str, schema: str) -> DataFrame:
        """Rows of a part of the live segments that no later segment has taken out."""
        read = lambda part, schema, of: spark.read.schema(f"{schema}, segment int").option("basePath", f"{folder}/{part}").parquet(*(f"{folder}/{part}/segment={m['segment']}" for m in of))
        rows, cuts = read(part, schema, live), [m for m in live if m["gone"]]
        if not cuts:
            return rows
        gone = read("gone", "id long", cuts).select(F.col("id").alias("_id"), F.col("segment").alias("_segment"))
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_segment")), "left_anti")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Index:
        live = Index._live(spark, folder)
        if not live:
            raise QueryError("no_index", folder)
        n, tokens = sum(m["docs"] for m in live), sum(m["tokens"] for m in live)
        totals = spark.createDataFrame([(n, tokens / n if n else None)], "n_docs long, mean_len double")
        rows = Index._standing(spark, folder, live, "postings", "id long, len int, pos int, term string, bucket int")
        return Index(rows, Index._standing(spark, folder, live, "docs", "id long, len int, digest long").select("id", "len"), totals, live[-1]["buckets"])

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms. Their buckets are computed here, so that the scan is pruned when it is planned."""
        spark = self.postings.sparkSession
        named = spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = sorted({r[0] for r in named.select(Index.bucket(F.col("term"), self.buckets)).collect()})  # one row per query term
        return self.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket", "segment")


def _of(index: DataFrame | Index, terms: list[str]) -> DataFrame:
    return index.of(terms) if isinstance(index, Index) else index.where(F.col("term").isin(terms))


def _occurrences(index: DataFrame, element: tuple[str, ...]) -> DataFrame:
    """(id, len, tf) of a word, or of a phrase as consecutive positions."""
    at = index.where(F.col("term") == element[0]).select("id", "len", "pos")
    for k, part in enumerate(element[1:], 1):
        at = at.join(index.where(F.col("term") == part).select("id", (F.col("pos") - k).alias("pos")), ["id", "pos"], "left_semi")
    return at.groupBy("id").agg(F.first("len").alias("len"), F.count("*").alias("tf"))


def matched(index: DataFrame | Index, elements: list[tuple[str, ...]]) -> DataFrame:
    """(id, element, tf, len) for every element found, len being the document's; single words share one pass over the index."""
    index = _of(index, sorted({part for e in elements for part in e})) if isinstance(index, Index) else index
    words = [e[0] for e in elements if len(e) == 1]
    number = {e: i for i, e in enumerate(elements)}
    out = None
    if words:
        which = F.create_map(*(x for w in words for x in (F.lit(w), F.lit(number[(w,)]))))
        out = index.where(F.col("term").isin(words)).groupBy("id", which[F.col("term")].alias("element")).agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    for e in elements:
        if len(e) > 1:
            found = _occurrences(index, e).select("id", F.lit(number[e]).alias("element"), "tf", "len")
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise QueryError("no_terms")
    return out


def bm25(index: DataFrame | Index, sizes: DataFrame | None, elements: list[tuple[str, ...]]) -> DataFrame:
    """(id, score), lower is better; document counts and mean length are those of the whole index. A written index has its own sizes."""
    hits = matched(index, elements)
    whole = index.totals if isinstance(index, Index) else sizes.agg(F.count("*").alias("n_docs"), F.avg("len").alias("mean_len"))  # one row
    df = hits.groupBy("element").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    # df has a row per query element, whole a single one
    rows = hits.join(F.broadcast(df), "element").join(F.broadcast(whole))
    return rows.groupBy("id").agg(F.round(-F.sum(gain), 9).alias("score"))


def document_frequency(index: DataFrame | Index, words: list[str] | None = None) -> DataFrame:
    rows = (index.postings if isinstance(index, Index) else index) if words is None else _of(index, words)
    return rows.select("id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def df_rule(index: DataFrame | Index, n_events: int, words: list[str], ratio: float, keep_one: bool = True) -> list[str]:
    """Words in at most ratio * n_events events, the rarest if none is and keep_one is set; small stores use the stopword list."""
    if n_events < LEAST_DF_EVENTS:
        return [w for w in words if w not in X.STOPWORDS]
    df = {r["term"]: r["df"] for r in document_frequency(index, words).collect()}  # at most one row per query word
    kept = [w for w in words if df.get(w, 0) <= ratio * n_events]
    return kept or (sorted(words, key=lambda w: (df.get(w, 0), words.index(w)))[:1] if keep_one else [])


def tally(scored: DataFrame, inside: Column) -> DataFrame:
    """(inside, label, session_root, n) over all eligible matches."""
    return scored.groupBy(F.coalesce(inside, F.lit(False)).alias("inside"), "label", "session_root").agg(F.count("*").alias("n"))


def other_scopes(counts: DataFrame, most: int = 5) -> DataFrame:
    return counts.where(~F.col("inside") & F.col("label").isNotNull()).groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(most)


def candidates(scored: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best matches with rank 1, 2, ...; a bounded set that later steps may order globally."""
    top = scored.orderBy("score", "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))


def compose(ranked: DataFrame, per_session: int = PER_SESSION) -> DataFrame:
    """First hit of each text in a session, with how often it repeats; at most per_session hits of a session."""
    same = Window.partitionBy("session_root", "text")
    first = ranked.withColumn("_d", F.row_number().over(same.orderBy("rank"))).withColumn("repeats", F.count("*").over(same) - 1).where("_d = 1").drop("_d")
    return first.withColumn("_k", F.row_number().over(Window.partitionBy("session_root").orderBy("rank"))).where(F.col("_k") <= per_session).drop("_k")


def recent_first(composed: DataFrame, most: int = RECENT) -> DataFrame:
    """The best `most`, newest first; events without ts come last, equals keep their rank."""
    top = composed.orderBy("rank").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce("ts", F.lit(""))), "rank")))


def more_in_session(page: DataFrame, counts: DataFrame, per_session: int = PER_SESSION) -> DataFrame:
    """What a session holds beyond the hits shown and their repeats, where the cap was reached."""
    total = counts.where("inside").groupBy("session_root").agg(F.sum("n").alias("_total"))
    shown = page.withColumn("_hits", F.count("*").over(Window.partitionBy("session_root"))).withColumn("_covered", F.sum(F.col("repeats") + 1).over(Window.partitionBy("session_root")))
    more = F.col("_total") - F.col("_covered")
    return shown.join(total, "session_root", "left").withColumn("more_in_session", F.when((F.col("_hits") >= per_session) & (more > 0), more)).drop("_total", "_hits", "_covered")


def stages(counts: DataFrame, ranked: DataFrame, composed: DataFrame) -> DataFrame:
    """One row: matches, in_scope, candidates, session_capped, returned."""
    a = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("in_scope"))
    b = ranked.agg(F.count("*").alias("candidates"))
    c = composed.agg(F.coalesce(F.sum(F.col("repeats") + 1), F.lit(0)).alias("_kept"), F.count("*").alias("returned"))
    return a.join(b).join(c).select("matches", "in_scope", "candidates", (F.col("candidates") - F.col("_kept")).alias("session_capped"), "returned")


@dataclass
class Search:
    """Frames of one search; each is lazy."""

    scored: DataFrame
    counts: DataFrame
    ranked: DataFrame
    composed: DataFrame

    def page(self, limit: int = 10, page: int = 1, recent: bool = False, per_session: int = PER_SESSION) -> DataFrame:
        limit, page = max(1, min(limit, MOST_LIMIT)), max(1, page)
        rows = recent_first(self.composed) if recent else self.composed
        rows = more_in_session(rows, self.counts, per_session)
        at = rows.withColumn("_n", F.row_number().over(Window.orderBy("rank")))
        return at.where((F.col("_n") > limit * (page - 1)) & (F.col("_n") <= limit * page)).drop("_n")


def search(event: DataFrame, source: DataFrame, scope: DataFrame, text: str, where: Column | None = None, inside: Column | None = None, per_session: int = PER_SESSION, drop: frozenset[str] | None = None, index: Index | None = None) -> Search:
    """Scores come from the whole index, the written one if it is given; eligibility and scope apply before the best matches are taken."""
    query = parse(text, drop)
    if not query.elements:
        raise QueryError("no_terms", text)
    scores = bm25(index or postings(event), None if index else lengths(event), query.elements)
    eligible = filters.joined(event, source, scope).where(filters.eligible() if where is None else where).join(scores, "id")
    inside = F.lit(True) if inside is None else inside
    ranked = candidates(eligible.where(F.coalesce(inside, F.lit(False))))
    return Search(eligible, tally(eligible, inside), ranked, compose(ranked, per_session))


def hits(page: DataFrame) -> DataFrame:
    """The columns of an answer's hits."""
    return page.select("id", filters.ref().alias("ref"), "ts", "provider", F.left("session_root", F.lit(8)).alias("session"), F.left("thread_id", F.lit(8)).alias("thread"), "kind", "role", F.col("label").alias("scope"), F.col("status").alias("source_status"), filters.citable().alias("answer_citable"), "repeats", X.preview(F.col("text")).alias("preview"))


def recall(found: Search, index: DataFrame | Index, words: list[str], least: int = 3, most: int = 3, pool: int = 20) -> DataFrame:
    """The best hits of the first `pool` that match at least `least` different words."""
    if len(words) < least:
        return found.composed.limit(0).withColumn("n_words", F.lit(0).cast("long"))
    top = found.composed.orderBy("rank").limit(pool)
    n = _of(index, words).select("id", "term").distinct().groupBy("id").agg(F.count("*").alias("n_words"))
    return top.join(n, "id").where(F.col("n_words") >= least).orderBy("rank").limit(most)


def quoted(event: DataFrame, quote: str) -> DataFrame:
    """Events that hold a quote, white space compared loosely."""
    return event.where(F.instr(X.collapse(F.col("text")), " ".join(quote.split())) > 0)


def replay(ranked: DataFrame, questions: DataFrame, final: int = 10) -> DataFrame:
    """Rank of every required id of a question and whether it is on the final page."""
    at = questions.join(ranked.select("id", "rank"), F.col("required") == F.col("id"), "left")
    return at.select("question", "required", "rank", F.coalesce(F.col("rank") <= final, F.lit(False)).alias("in_final"))


def replay_summary(rows: DataFrame) -> DataFrame:
    each = rows.groupBy("question").agg(F.bool_and("in_final").alias("complete"), F.avg(F.col("rank").isNotNull().cast("int")).alias("recall"))
    return each.agg(F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("candidate_recall"), F.round(F.avg(F.col("complete").cast("int")), 6).alias("complete_at_final"))


def diversity(page: DataFrame) -> DataFrame:
    n = page.groupBy("session_root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return n.agg(F.count("*").alias("sessions"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.sum("bytes").alias("bytes"))
