"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import derived
from postlens import runtime
from postlens.functions import entities as entity_functions, scalars, text
from postlens.operators import entities, evaluate, features, knn, labels, ngrams, sampling, topics
from postlens.operators.sentiment import add_modified_sentiment, add_sentiment
from postlens.plans import enrich, model_runs, model_state
from postlens.sources import capture, files
from postlens.streaming import inbox, months

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# parameters of the registered runs; the oracle uses the same
KEYWORD = "the"
KEYWORDS = ("the", "Tion", "er", "ing the")
CAPTURE_START, CAPTURE_END = datetime.date(2021, 3, 1), datetime.date(2021, 6, 15)
WINDOW_START, WINDOW_END = datetime.date(2022, 1, 1), datetime.date(2022, 1, 31)
MONTH_END = datetime.date(2022, 2, 1)
SHARE = 0.5
GRID_SHARES, GRID_KS = (0.25, 0.5), (3, 5)
K = 7
MONTH_K = 9


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- shared inputs -------------------------------------------------------------------


def _raw(spark, sf):
    return derived.raw_posts(spark, sf)


def _base(spark, sf):
    return enrich.clean_posts(_raw(spark, sf), derived.lexicon(spark, sf))


def _captured(spark, sf):
    """Cleaned posts of two captures, ids repeated within and across them."""
    return enrich.clean_posts(derived.captured_posts(spark, sf), derived.lexicon(spark, sf))


def _families(spark, sf):
    return enrich.process_raw(_raw(spark, sf), derived.lexicon(spark, sf), staged=True)


def _captured_families(spark, sf):
    return enrich.process_raw(derived.captured_posts(spark, sf), derived.lexicon(spark, sf), staged=True)


def _posts(spark, sf):
    return _families(spark, sf)["posts"]


def _classes(spark, posts):
    return labels.class_lookup(derived.hashtag_classes(spark, posts))


def _staged_posts(spark, sf):
    return runtime.stage(_posts(spark, sf), "posts")


def _labelled(posts):
    return labels.label_posts(labels.model_rows(posts), _classes(posts.sparkSession, posts))


def _staged_labels(spark, sf):
    """Narrow labelled posts: id and category."""
    return runtime.stage(_labelled(_staged_posts(spark, sf)).select("id", "category"), "labels")


def _six(name):
    return F.round(F.col(name), 6).alias(name)


# ---- sources and sinks ---------------------------------------------------------------


@query
def capture_monthly(spark, sf):
    found = capture.capture_monthly(derived.archive(spark, sf), KEYWORD, CAPTURE_START, CAPTURE_END)
    return found.select("id", scalars.day(F.col("date")).alias("date"), "username", "content", "window_start", "window_end")


@query
def capture_keywords(spark, sf):
    """All keywords in one scan, over an archive with signatures."""
    archive = runtime.stage(capture.with_signature(derived.archive(spark, sf)), "signed")
    found = capture.capture_keywords(archive, KEYWORDS, CAPTURE_START, CAPTURE_END)
    return found.select("keyword", "id", scalars.day(F.col("date")).alias("date"), "capture", "window_start", "window_end")


@query
def capture_window(spark, sf):
    found = capture.capture_window(derived.archive(spark, sf), KEYWORD, WINDOW_START, WINDOW_END)
    return found.select("id", scalars.day(F.col("date")).alias("date"), "username", "content", "url")


@query
def read_raw(spark, sf):
    path = runtime.scratch_path(spark, "raw")
    files.write_raw(_raw(spark, sf), path)
    rows = files.read_raw(spark, path)
    return rows.drop("capture").withColumn("date", scalars.day(F.col("date"))).fillna("", ["content"])


def _stored_families(spark, sf):
    folders = []
    frames = _captured_families(spark, sf)
    early = F.col("month") < F.lit(datetime.date(2021, 7, 1))
    for name, part in (("early", early), ("late", ~early)):
        folder = runtime.scratch_path(spark, name)
        files.write_families({n: f.filter(part) for n, f in frames.items()}, folder)
        folders.append(folder)
    return folders


FAMILY_COLUMNS = [
    "family", "id", "month", "content", "sentiment", "username", "display_name",
    "mentioned_usernames", "mentioned_display_names", "hashtags",
]


def _stacked(tables):
    rows = [t.withColumn("family", F.lit(name)) for name, t in tables.items()]
    return files.union_by_name(rows).withColumn("sentiment", _six("sentiment")).select(*FAMILY_COLUMNS)


@query
def union_files(spark, sf):
    folders = _stored_families(spark, sf)
    return _stacked({name: files.union_files(spark, folders, name) for name in files.FAMILIES})


@query
def load_text_tables(spark, sf):
    folder = runtime.scratch_path(spark, "families")
    frames = _captured_families(spark, sf)
    files.write_families(frames, folder)
    placed = topics.join_topic_label(derived.with_topic(frames["posts"]), derived.topic_labels(spark))
    placed.write.parquet(f"{folder}/post_topics")
    return _stacked(files.load_text_tables(spark, folder, f"{folder}/post_topics"))


@query
def class_lookup(spark, sf):
    return _classes(spark, _posts(spark, sf))


@query
def bi_export(spark, sf):
    families = _captured_families(spark, sf)
    topics_table = topics.join_topic_label(derived.with_topic(families["posts"]), derived.topic_labels(spark))
    tables = files.report_tables(topics_table, families["hashtag_lists"], families["mention_lists"])
    rows = [t.withColumn("report", F.lit(name)) for name, t in tables.items()]
    return files.union_by_name(rows).select(
        "report", "id", F.col("date").cast("string").alias("date"), "username", "display_name", "content",
        F.col("like_count").cast("string").alias("like_count"), "polarity",
        F.col("topic").cast("string").alias("topic"), "topic_label", "hashtags",
    )


# ---- scalar functions ----------------------------------------------------------------


@query
def clean_remove(spark, sf):
    posts = _raw(spark, sf).select(F.lit("post").alias("kind"), "id", text.strip_markup(F.col("content")).alias("text"))
    pages = derived.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.strip_markup(F.col("html")).alias("text")
    )
    return posts.unionByName(pages)


@query
def clean_text(spark, sf):
    posts = _raw(spark, sf).select(F.lit("post").alias("kind"), "id", text.clean_text(F.col("content")).alias("text"))
    pages = derived.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.clean_text(F.col("html")).alias("text")
    )
    return posts.unionByName(pages)


@query
def date_parts(spark, sf):
    return derived.table(spark, sf, "events").select(
        "event_id", scalars.day(F.col("ts")).alias("date"), scalars.month_start(F.col("ts")).alias("month")
    )


@query
def polarity_label(spark, sf):
    return _base(spark, sf).select("id", scalars.polarity_label(F.col("sentiment")).alias("polarity"))


@query
def round_scores(spark, sf):
    return _base(spark, sf).select(
        "id", *[scalars.round_half_even(F.col(c)).alias(c) for c in ("sentiment", "subjectivity")]
    )


@query
def train_validation_filter(spark, sf):
    posts = _staged_posts(spark, sf)
    train = labels.model_rows(posts).withColumn("part", F.lit("train"))
    held_out = labels.model_rows(posts, training=False).withColumn("part", F.lit("validation"))
    return files.union_by_name([train, held_out])


@query
def month_exclusion(spark, sf):
    return ngrams.without_year(_base(spark, sf), 2022).select("id", "month")


@query
def prediction_check(spark, sf):
    rows = derived.predictions(_labelled(_staged_posts(spark, sf)), spark, sf)
    return rows.withColumn("check", scalars.prediction_check(F.col("actual"), F.col("prediction")))


@query
def tfpn_check(spark, sf):
    rows = derived.predictions(_labelled(_staged_posts(spark, sf)), spark, sf)
    return evaluate.outcome_checks(rows, labels.SURVIVOR, labels.OTHER)


# ---- entities ------------------------------------------------------------------------


@query
def mention_parse(spark, sf):
    users = F.col("mentioned_users")
    return derived.captured_posts(spark, sf).filter(users.isNotNull()).select(
        "id",
        "capture",
        F.array_join(entity_functions.mention_usernames(users), "|").alias("usernames"),
        F.array_join(entity_functions.mention_display_names(users), "|", "?").alias("display_names"),
    )


@query
def mention_lists(spark, sf):
    rows = entities.mention_lists(entities.parsed_mentions(_captured(spark, sf)))
    return rows.select("capture", "id", "date", "month", "username", "display_name")


@query
def mention_strings(spark, sf):
    rows = entities.mention_strings(entities.parsed_mentions(_captured(spark, sf)))
    return rows.select("capture", "id", "date", "month", "username", "display_name")


@query
def hashtag_parse(spark, sf):
    tags = F.col("hashtags")
    return derived.captured_posts(spark, sf).filter(tags.isNotNull()).select(
        "capture", "id", F.array_join(entity_functions.hashtag_array(tags), "|").alias("tags")
    )


@query
def hashtag_lists(spark, sf):
    rows = entities.hashtag_lists(entities.parsed_hashtags(_captured(spark, sf)))
    return rows.select("capture", "id", "date", "month", "hashtags")


@query
def hashtag_strings(spark, sf):
    rows = entities.hashtag_strings(entities.parsed_hashtags(_captured(spark, sf)))
    return rows.select("capture", "id", "date", "month", "hashtags")


def _rounded_posts(posts):
    return posts.withColumns({"sentiment": _six("sentiment"), "subjectivity": _six("subjectivity")})


@query
def post_enrich(spark, sf):
    return _rounded_posts(_captured_families(spark, sf)["posts"])


# ---- joins ---------------------------------------------------------------------------


@query
def join_mentions(spark, sf):
    base = _captured(spark, sf)
    mentions = entities.mention_strings(entities.parsed_mentions(base))
    posts = base.select("capture", "id", "month", "like_count")
    return entities.join_mentions(posts, mentions)


@query
def join_hashtags(spark, sf):
    base = _captured(spark, sf)
    hashtags = entities.hashtag_strings(entities.parsed_hashtags(base))
    return entities.join_hashtags(base.select("capture", "id", "month", "like_count"), hashtags)


@query
def join_topic_label(spark, sf):
    posts = derived.with_topic(_raw(spark, sf).select("id", "username"))
    return topics.join_topic_label(posts, derived.topic_labels(spark))


@query
def join_validation_raw(spark, sf):
    held_out = labels.model_rows(_staged_posts(spark, sf), training=False).select("id", "mentions", "hashtags")
    raw = capture.capture_window(derived.archive(spark, sf), "", WINDOW_START, MONTH_END, language=None)
    return model_runs.join_raw(held_out, raw)


@query
def hashtag_weight_lookup(spark, sf):
    posts = _staged_posts(spark, sf)
    rows = labels.model_rows(posts).select("id", "hashtags")
    return labels.add_hashtag_weights(rows, _classes(spark, posts))


@query
def month_semi(spark, sf):
    base = _base(spark, sf)
    months = ngrams.distinct_months(base, 2022)
    tags = entities.hashtag_lists(entities.parsed_hashtags(base)).select("id", "month", "hashtags")
    return ngrams.in_months(tags, months).select("id", "month", "hashtags")


# ---- aggregations --------------------------------------------------------------------


@query
def ngram_counts(spark, sf):
    docs = derived.table(spark, sf, "documents")
    return ngrams.ngram_counts(docs, "text", (1, 2, 3))


def _monthly(spark, sf):
    families = _families(spark, sf)
    return ngrams.monthly_ngrams(families["posts"], families["hashtags"], families["mentions"])


@query
def monthly_ngrams(spark, sf):
    return _monthly(spark, sf)


@query
def monthly_ngrams_by_levels(spark, sf):
    families = _families(spark, sf)
    return ngrams.monthly_ngrams_by_levels(families["posts"], families["hashtags"], families["mentions"])


@query
def collated_ngrams(spark, sf):
    return ngrams.collated_ngrams(_monthly(spark, sf))


@query
def distinct_months(spark, sf):
    return ngrams.distinct_months(_base(spark, sf))


@query
def class_counts(spark, sf):
    rows = _labelled(_staged_posts(spark, sf)).select("id", "category")
    return sampling.class_counts(rows, ["category"])


@query
def class_distribution(spark, sf):
    return evaluate.class_distribution(_labelled(_staged_posts(spark, sf))).withColumn("distribution", _six("distribution"))


@query
def confusion_pivot(spark, sf):
    rows = derived.predictions(_labelled(_staged_posts(spark, sf)), spark, sf)
    return evaluate.confusion_pivot(rows).withColumn("accuracy", _six("accuracy"))


@query
def overall_accuracy(spark, sf):
    return evaluate.overall_accuracy(derived.predictions(_labelled(_staged_posts(spark, sf)), spark, sf))


@query
def tfpn_summary(spark, sf):
    rows = derived.predictions(_labelled(_staged_posts(spark, sf)), spark, sf)
    checked = evaluate.outcome_checks(rows, labels.SURVIVOR, labels.OTHER)
    return evaluate.outcome_summary(checked)


@query
def sentiment_mean(spark, sf):
    """The shuffled way of the lexicon scores, for lexicons of any length."""
    words = text.clean_words(F.col("content"))
    rows = add_sentiment(_raw(spark, sf).select("id", "content"), words, derived.lexicon(spark, sf), max_rows=0)
    return rows.select("id", _six("sentiment"), _six("subjectivity"))


@query
def sentiment_modified(spark, sf):
    words = text.clean_words(F.col("content"))
    rows = add_modified_sentiment(
        _raw(spark, sf).select("id", "content"), words, derived.lexicon(spark, sf), derived.NEGATIONS
    )
    return rows.select("id", _six("sentiment"), "polarity", _six("subjectivity"))


# ---- sort, limit, samples ------------------------------------------------------------


@query
def top_words(spark, sf):
    posts = _base(spark, sf)
    return ngrams.top_words(posts, "content", 2, top=20, containing="en", exclusions=derived.exclusions(spark))


@query
def top_words_by_summaries(spark, sf):
    posts = _base(spark, sf)
    return ngrams.top_words_by_summaries(posts, "content", 2, top=20, containing="en", exclusions=derived.exclusions(spark))


@query
def top_words_monthly(spark, sf):
    return ngrams.top_words_by(_base(spark, sf), "content", "month", 1, top=20)


@query
def sort_counts(spark, sf):
    return ngrams.sort_counts(ngrams.ngram_counts(_base(spark, sf), "content", 1))


@query
def dominant_topic(spark, sf):
    return derived.table(spark, sf, "embeddings").select(
        "vec_id", topics.dominant_topic(F.col("embedding")).alias("topic")
    )


@query
def largest_category(spark, sf):
    posts = _staged_posts(spark, sf)
    rows = labels.add_hashtag_weights(labels.model_rows(posts).select("id", "hashtags"), _classes(spark, posts))
    return rows.select("id", labels.largest_category().alias("category"))


@query
def sample_uniform(spark, sf):
    return sampling.sample_uniform(_staged_labels(spark, sf), SHARE, "uniform")


@query
def sample_weighted(spark, sf):
    return sampling.sample_weighted(_staged_labels(spark, sf), SHARE, "weighted").select("id", "category")


@query
def stratified_split(spark, sf):
    rows = sampling.stratified_split(_staged_labels(spark, sf), "split")
    return rows.select("id", "category", F.col("is_test").cast("int").alias("is_test"))


def _split(spark, sf):
    rows = features.as_single_run(_labelled(_staged_posts(spark, sf)))
    rows = runtime.stage(sampling.stratified_split(runtime.stage(rows, "labelled"), "split"), "split")
    return rows.filter(~F.col("is_test")).drop("is_test"), rows.filter("is_test").drop("is_test")


@query
def knn_topk(spark, sf):
    train, test = _split(spark, sf)
    nearest = knn.neighbours(train, test.drop("category"), K)
    return nearest.select("id", "rank", "train_id", "category", _six("distance2"))


# ---- text analytics and learning -----------------------------------------------------


@query
def lexicon_sentiment(spark, sf):
    return _base(spark, sf).select("id", _six("sentiment"), "polarity", _six("subjectivity"))


@query
def topic_model(spark, sf):
    placed, names = topics.topic_model(_base(spark, sf).select("id", "content"))
    return topics.join_topic_label(placed, names).select("id", "topic", "topic_label")


@query
def topic_labels(spark, sf):
    return topics.topic_model(_base(spark, sf).select("id", "content"))[1]


@query
def label_posts(spark, sf):
    return _labelled(_staged_posts(spark, sf))


def _method(number):
    def run(spark, sf):
        return model_runs.apply_method(_staged_labels(spark, sf), number, SHARE).select("id", "category")

    return run


for _number in range(5):
    QUERIES[f"apply_method_{_number}"] = _method(_number)


def _model_rows(posts, training=True):
    return features.as_single_run(labels.model_rows(posts, training))


@query
def tfidf_fit(spark, sf):
    model = features.fit(_model_rows(_staged_posts(spark, sf)))
    return model.idf.select("block", "token", "df", _six("idf"))


@query
def tfidf_by_months(spark, sf):
    """The vocabulary of ``tfidf_fit`` out of sums kept for each month, one of which has come and gone."""
    rows = _model_rows(_staged_posts(spark, sf))
    rows = runtime.stage(rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(3))), "month-parts")
    folder = runtime.scratch_path(spark, "months")
    for part in range(3):
        model_state.add_month(rows.where(F.col("_part") == part), datetime.date(2021, part + 1, 1), folder)
    model_state.withdraw_month(spark, datetime.date(2021, 2, 1), folder)
    model_state.add_month(rows.where("_part = 1"), datetime.date(2021, 2, 1), folder, "again")
    return model_state.model(spark, folder).idf.select("block", "token", "df", _six("idf"))


@query
def tfidf_transform(spark, sf):
    posts = _staged_posts(spark, sf)
    model = features.fit(_model_rows(posts))
    return model.transform(_model_rows(posts, training=False)).select("id", "block", "token", _six("weight"))


@query
def assemble_features(spark, sf):
    rows = _model_rows(_staged_posts(spark, sf))
    weights = features.fit(rows).transform(rows)
    return features.assemble_features(weights, rows).select("id", "block", "token", _six("weight"))


@query
def knn_classify(spark, sf):
    posts = _staged_posts(spark, sf)
    train = runtime.stage(_labelled(posts), "train")
    held_out = runtime.stage(labels.model_rows(posts, training=False), "validation")
    return knn.classify(train, held_out, [K]).select("id", "prediction")


@query
def knn_holdout(spark, sf):
    return model_runs.knn_holdout(_labelled(_staged_posts(spark, sf)), K)[0]


@query
def knn_grid(spark, sf):
    keys, shares, classes = model_runs.knn_grid(_labelled(_staged_posts(spark, sf)), GRID_SHARES, GRID_KS)
    # the three result tables side by side; a class too small to be tested has zeros
    tested = classes.withColumnRenamed("accuracy", "class_accuracy")
    rows = shares.join(keys, "key").join(tested, ["key", "category"], "left")
    return rows.fillna(0, ["correct", "incorrect", "class_accuracy"]).withColumns(
        {name: _six(name) for name in ("accuracy", "distribution", "class_accuracy")}
    )


@query
def method_testing(spark, sf):
    survivor, other = model_runs.outcome_tables(_labelled(_staged_posts(spark, sf)), SHARE, K)
    return survivor.withColumn("check", F.lit("survivor")).unionByName(other.withColumn("check", F.lit("other")))


@query
def knn_score_month(spark, sf):
    posts = _staged_posts(spark, sf)
    raw = capture.capture_window(derived.archive(spark, sf), "", WINDOW_START, MONTH_END, language=None)
    return model_runs.score_month(
        _labelled(posts), labels.model_rows(posts, training=False), raw, SHARE, MONTH_K, 0
    )


# ---- streaming -----------------------------------------------------------------------


@query
def stream_months(spark, sf):
    """Events by month and type, in two runs of a stream over files dealt by hash, so that most of the second is late."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    box, folder, checkpoint = (runtime.scratch_path(spark, name) for name in ("events", "event-months", "event-checkpoint"))
    for part in range(2):
        events.where(F.pmod(F.xxhash64("ts", "event_type"), F.lit(2)) == part).write.mode("append").parquet(box)
        stream = spark.readStream.schema(events.schema).parquet(box)
        months.count_months(stream, "ts", ["event_type"], folder, checkpoint, too_late=datetime.timedelta(days=40_000)).awaitTermination()
    return months.months(spark, folder, T.StructType([events.schema["event_type"]])).select("month", "event_type", "n")


@query
def ingest_inbox(spark, sf):
    folder = runtime.scratch_path(spark, "inbox")
    posts = derived.captured_posts(spark, sf)
    # every file is a capture; all rows of an id in a capture go to the same file
    for name, place in (("a", "inbox"), ("b", "inbox/later")):
        files.write_raw(posts.filter(F.col("capture") == name).repartition("id"), f"{folder}/{place}")
    run = inbox.ingest_inbox(
        spark, f"{folder}/inbox", derived.lexicon(spark, sf), f"{folder}/out", f"{folder}/checkpoint",
        archive=f"{folder}/archive",
    )
    run.awaitTermination()
    return _rounded_posts(inbox.processed(spark, f"{folder}/out", "posts"))
