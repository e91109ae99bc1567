"""Readers that turn files and raw tables into labelled records (S1-S5), and the log reader."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.spread import counted_broadcast
from ..functions.text import first_words, sha, state_key
from ..session import settle

MAX_OPTIONS = 255
SPLIT_BYTES = 400           # a row of the table of file splits, file path included
QUESTION = "struct<type:string,instructions:string,criteria:string,label:variant,target:string>"
RECORD = f"state string, questions map<string,{QUESTION}>, _bad string"

# truth words of a yes/no label (fixed values)
TRUE_WORDS = ("true", "t", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "f", "no", "n", "0", "off")


def number_lines(df):
    """1-based line number inside each file without a global sort: rows are numbered inside their file split, and split
    sizes (one row per split) give the offset of each split. `df` is a plain text scan."""
    base = df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("_m"))
    sizes = base.groupBy("file", "block").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = settle(sizes.select("file", "block", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")))
    # one row per file split: broadcast after a look at its size, so that the lines themselves are not shuffled
    out = base.join(counted_broadcast(sizes, SPLIT_BYTES), ["file", "block"])
    return out.select("value", "file", (F.col("_off") + F.col("_m") - F.col("_m0") + 1).alias("line"))


def read_labelled_jsonl(spark, path, source):
    """(records, problems). Blank lines are skipped; a line that is not a JSON object, or whose record breaks a rule,
    becomes a problem row with its line number. Ids are source and line; where the path holds several files, a digest of the file stands between."""
    text = spark.read.text(path)
    many = len(text.inputFiles()) > 1
    lines = number_lines(text).filter(F.trim("value") != "")
    name = F.concat_ws("/", F.lit(source), *([F.substring(F.sha2("file", 256), 1, 12)] if many else []), F.col("line").cast("string"))
    parsed = lines.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    parsed = parsed.withColumn("problems", F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.array(F.lit("not_json")))
                               .otherwise(record_problems(F.col("r.state"), F.col("r.questions"))))
    bad = parsed.filter(F.size("problems") > 0).select("file", "line", F.explode("problems").alias("problem"))
    good = parsed.filter(F.size("problems") == 0).select(
        name.alias("id"), name.alias("group_id"),
        F.col("r.state").alias("state"), F.col("r.questions").alias("questions"), F.lit("clean").alias("variant"), F.lit(source).alias("source"),
        state_key(F.col("r.state")).alias("text_sha256"), "line")
    return good, bad


def option_keys(kind, criteria):
    """Option keys in option order: names of a choice, false/true, level numbers of a score."""
    levels = F.from_json(criteria, "array<string>")
    return (F.when(kind == "choice", F.json_object_keys(criteria)).when(kind == "noul", F.array(F.lit("false"), F.lit("true")))
            .otherwise(F.when(F.size(levels) > 0, F.transform(levels, lambda x, i: i.cast("string")))))


def question_problems(qid, q):
    """V1: problem codes of one labelled question, prefixed with its id."""
    kind, crit, label = q["type"], q["criteria"], q["label"]
    ltype = F.schema_of_variant(label)
    text = F.try_variant_get(label, "$", "string")
    number = F.try_variant_get(label, "$", "bigint")
    is_obj, is_arr = F.ltrim(crit).startswith("{"), F.ltrim(crit).startswith("[")
    names = F.json_object_keys(crit)
    levels = F.size(F.from_json(crit, "array<string>"))
    target = F.from_json(q["target"], "map<string,double>")
    weights = F.map_values(target)
    keys = option_keys(kind, crit)
    no_label = label.isNull() | F.coalesce(F.is_variant_null(label), F.lit(False))
    has = ~no_label

    def when(cond, code):
        return F.when(F.coalesce(cond, F.lit(False)), F.concat_ws(":", qid, F.lit(code)))
    known = kind.isin("noul", "choice", "score")
    choice_ok = is_obj & F.size(names).between(1, MAX_OPTIONS)
    score_ok = is_arr & levels.between(2, MAX_OPTIONS)
    return F.array_compact(F.array(
        when(kind.isNull() | ~known, "unknown_type"),
        when(known & (q["instructions"].isNull() | (q["instructions"] == "")), "instructions_missing"),
        when(known & no_label, "label_missing"),
        when((kind == "noul") & has & (ltype != "BOOLEAN"), "noul_label"),
        when((kind == "noul") & has & crit.isNotNull() & (~is_obj | (F.size(F.array_except(names, F.array(F.lit("true"), F.lit("false")))) > 0)), "noul_criteria"),
        when((kind == "choice") & has & (crit.isNull() | ~F.coalesce(choice_ok, F.lit(False))), "choice_criteria"),
        when((kind == "choice") & has & choice_ok & ((ltype != "STRING") | ~F.array_contains(names, text)), "choice_label"),
        when((kind == "score") & has & (crit.isNull() | ~F.coalesce(score_ok, F.lit(False))), "score_criteria"),
        when((kind == "score") & has & score_ok & (~ltype.isin("BIGINT") | ~number.between(0, levels - 1)), "score_label"),
        when(known & has & q["target"].isNotNull() & (target.isNull() | (F.size(F.array_except(F.map_keys(target), keys)) > 0)
             | F.exists(weights, lambda w: w.isNull() | (w < 0)) | (F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) <= 0)), "target")))


def record_problems(state, questions):
    """V1: problem codes of a whole record."""
    head = F.array_compact(F.array(F.when(state.isNull(), "state_missing").when(state == "", "state_empty"),
                                   F.when(state.isNotNull() & (questions.isNull() | (F.size(questions) < 1)), "questions_missing")))
    each = F.flatten(F.transform(F.map_entries(questions), lambda e: question_problems(e["key"], e["value"])))
    return F.when(state.isNull(), head).otherwise(F.concat(head, F.coalesce(each, F.array().cast("array<string>"))))


def read_export(spark, path, fmt, state_cols, label_cols):
    """CSV/TSV with header, JSON array or JSON lines. Dotted columns reach into nested JSON; several state columns make
    an object state without its empty fields; a row with only empty state columns gets `reason`. `label_cols` maps
    question id -> column. Columns are read as text, never inferred."""
    wanted = list(dict.fromkeys([*state_cols, *label_cols.values()]))
    if fmt in ("csv", "tsv"):
        raw = spark.read.csv(path, sep="\t" if fmt == "tsv" else ",", header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
        cols = {c: F.col(f"`{c}`") for c in wanted}
        base = raw
    else:
        if fmt == "json":
            base = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("row"))
        else:
            base = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("row"))
        cols = {c: F.get_json_object("row", "$." + c) for c in wanted}
    filled = {c: F.when(cols[c] != "", cols[c]) for c in state_cols}
    empty = ~F.greatest(*[f.isNotNull() for f in filled.values()], F.lit(False))
    state = cols[state_cols[0]] if len(state_cols) == 1 else F.to_json(F.struct(*[f.alias(c) for c, f in filled.items()]))
    return base.select(F.when(~empty, state).alias("state"), *[cols[c].alias(q) for q, c in label_cols.items()],
                       F.when(empty, F.lit("empty state")).alias("reason"))


# ---- table-driven source adapters ----------------------------------------------------------------------------------
def adapt_source(df, spec):
    """S3: rows of one public dataset as labelled questions. `spec`:
    text (column), label (column), words (keep the first n words), strip_breaks, labels (ordered names for a choice),
    question = dict(qid, type, instructions), per_option = how many extra yes/no questions to derive (picked by digest),
    threshold = (qid, instructions, level) for a derived yes/no question. Label -1 is dropped."""
    label = F.col(spec["label"]).cast("int")
    text = F.col(spec["text"])
    if spec.get("strip_breaks"):
        text = F.replace(text, F.lit("<br />"), F.lit(" "))
    if spec.get("words"):
        text = first_words(text, spec["words"])
    names = [n.lower().replace(" ", "_") for n in spec.get("labels", ())]
    q = spec["question"]

    def question(qid, kind, instructions, keys, key):
        return F.struct(F.lit(qid).alias("qid") if isinstance(qid, str) else qid.alias("qid"), F.lit(kind).alias("type"),
                        (F.lit(instructions) if isinstance(instructions, str) else instructions).alias("instructions"), keys.alias("keys"), key.alias("label"))
    yes_no = F.array(F.lit("false"), F.lit("true"))
    arr = F.array(*[F.lit(n) for n in names]) if names else yes_no
    if q["type"] == "choice":
        main = question(q["qid"], "choice", q["instructions"], arr, F.element_at(arr, label + 1))
    elif q["type"] == "score":
        main = question(q["qid"], "score", q["instructions"], F.transform(arr, lambda x, i: i.cast("string")), label.cast("string"))
    else:
        main = question(q["qid"], "noul", q["instructions"], yes_no, F.when(label == 1, "true").otherwise("false"))
    qs = F.array(main)
    n = spec.get("per_option", 0)
    if n:
        picked = F.slice(F.array_sort(F.transform(arr, lambda k: F.struct(sha(F.col(spec["id"]), k).alias("o"), k.alias("k")))), 1, n)
        extra = F.transform(picked, lambda s: question(F.concat(F.lit("is_"), s["k"]), "noul", F.concat(F.lit("Is this about "), s["k"], F.lit("?")), yes_no,
                                                       F.when(s["k"] == F.element_at(arr, label + 1), "true").otherwise("false")))
        qs = F.concat(qs, extra)
    if spec.get("threshold"):
        qid, instructions, level = spec["threshold"]
        qs = F.concat(qs, F.array(question(qid, "noul", instructions, yes_no, F.when(label >= level, "true").otherwise("false"))))
    return (df.filter(label != -1).select(F.col(spec["id"]).alias("row_id"), text.alias("state"), F.lit(spec["source"]).alias("source"), F.inline(qs)))


def adapt_eval_rows(df):
    """External evaluation rows (option ids and texts as arrays, label index, perturbation name, target weights, and
    per-model published weights) as records: ordered options, label key, parent of a perturbed row, maps of distributions."""
    opts = F.arrays_zip(F.col("option_ids").alias("key"), F.col("option_texts").alias("desc"))
    clean = F.coalesce(F.col("perturbation"), F.lit("none")) == "none"
    return df.select(
        F.when(clean, F.col("row_id")).otherwise(F.concat_ws("/", "row_id", "perturbation")).alias("id"),
        F.when(clean, F.lit(None)).otherwise(F.col("row_id")).alias("parent_id"), F.when(clean, "clean").otherwise(F.col("perturbation")).alias("variant"),
        "state", opts.alias("options"), F.element_at("option_ids", F.col("label_idx").cast("int") + 1).alias("label_key"),
        F.map_from_arrays("option_ids", "target").alias("target"),
        F.transform_values("published", lambda m, w: F.map_from_arrays("option_ids", w)).alias("published"))


def in_order(col):
    """Sort key of an id in which runs of digits count as numbers of any length: each becomes its length and its digits."""
    parts = F.regexp_extract_all(col.cast("string"), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 9, "0"), number(x))).otherwise(x))


def merge_questions_by_state(df, place=None):
    """Rows with byte-equal state become one record with one question per question id, in question-id order; the record takes
    the id of its first row. Of several rows with one state and question id the last wins. Rows are in the order of the column
    `place` if it is named, else of their ids, numbers inside an id by value (`a/10` after `a/9`). States meet by digest; the
    text travels as a value."""
    at = F.struct(in_order(F.col("id")) if place is None else F.col(place), F.col("id"))
    rows = df.withColumn("_at", at)
    last = rows.groupBy(F.sha2("state", 256).alias("_k"), "qid").agg(F.min("_at").alias("_first"), F.max_by(F.struct("instructions", "label"), "_at").alias("_q"), F.min("state").alias("state"))
    g = last.groupBy("_k").agg(F.min("_first").getField("id").alias("id"), F.min("state").alias("state"), F.array_sort(F.collect_list(F.struct("qid", F.col("_q.instructions").alias("instructions"), F.col("_q.label").alias("label")))).alias("questions"))
    return g.drop("_k").withColumn("n_questions", F.size("questions").cast("bigint"))


def training_log_to_table(df, by="file"):
    """Step rows out of text logs with (file, line, value): epoch, step, loss, and whether the step is the last one
    seen of its epoch. The last step per epoch is an aggregate, so a long log is never sorted in one task."""
    pat = r"ep(?:och)?[ =:]*(\d+).*?step[ =:]*(\d+).*?loss[ =:]*([0-9.]+)"
    s = df.filter(F.col("value").rlike(pat)).select(
        by, "line", F.regexp_extract("value", pat, 1).cast("bigint").alias("epoch"), F.regexp_extract("value", pat, 2).cast("bigint").alias("step"),
        F.regexp_extract("value", pat, 3).cast("double").alias("loss"))
    last = s.groupBy(by, "epoch").agg(F.max("line").alias("_last"))
    return s.join(last, [by, "epoch"]).withColumn("is_last", F.col("line") == F.col("_last")).drop("_last")
