"""Column functions on texts: normal forms, hashes, n-grams, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize(text, strict: bool = False):
    """Lower case, white space collapsed and trimmed; strict also drops what is no letter, digit or underscore. Null gives ''."""
    c = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""), SPACE, " ")) if strict else c


def words(text):
    """Words of a normal form; '' has none."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def once(value, f):
    """f(value) with value evaluated once: inside f it is a lambda's variable, elsewhere a plan repeats it wherever it is named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(items, n: int, sep: str = " "):
    """All n-grams of an array of strings; a shorter array has none."""
    many = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), sep))
    return once(items, lambda w: F.when(F.size(w) >= n, many(w)).otherwise(F.array().cast("array<string>")))


def jaccard(a, b, empty: float = 1.0):
    """Of two arrays as sets; two empty sets give `empty`."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_distance(a, b):
    """Levenshtein distance over the longer length."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Null if a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


# Spellings of labels, types of human texts, quotes, and phrases that drop a record.
HUMAN = ("0", "human", "real", "human-written", "human_written")
MACHINE = ("1", "llm", "ai", "machine", "generated")
HUMAN_TYPES = ("abstract", "document", "story", "content")
QUOTES = ("“”‘’`´", '""' "''''")
REFUSALS = (
    r"(?:i|we)\W*(?:m|am|are)?\s+not\s+(?:able|bale|abel|albe|abli)\s+to\s+help",
    r"(?:i|we)\s+cannot\s+(?:fulfill|fulfil|comply|produce|generate|write)",
    r"as\s+(?:an?|the)\s+(?:ai|artificial\s+intelligence|large\s+language|language)\s+model",
    r"only\s+a\s+lan[guage]{3,6}\s+model",
    r"anthropic'?s?\s+ai",
    r"usage\s+guidelines",
    r"violate\s+(?:safety|ethical|community)\s+protocols",
    r"cannot\s+generate\s+(?:inappropriate|sexual|violent|harmful)",
    r"i\s+am\s+unable\s+to",
    r"regrettably,\s+as\s+a",
)
REFERENCE_NUMBER = r"\s*\[\d+(?:[-\u2013]\d+)?\][\.,]?"


def normalize_label(label, kind: str = "string"):
    """0 or 1 from a label; null if it is none. kind: 'string' takes the spellings, 'number' truncates (0.7 gives 0), 'boolean' is itself."""
    if kind == "string":
        s = F.lower(F.trim(label))
        return F.when(s.isin(*HUMAN), 0).when(s.isin(*MACHINE), 1)
    n = label.cast("int")
    return F.when(n.isin(0, 1), n)


def infer_label(labels: list, types: list):
    """The first of labels that is one; else 0 if a type is one of human texts, else 1."""
    human = F.lit(False)
    for t in types:
        human = human | F.coalesce(F.lower(F.trim(t)).isin(*HUMAN_TYPES), F.lit(False))
    return F.coalesce(*[normalize_label(x) for x in labels], F.when(human, 0).otherwise(1))


def first_filled(*cols):
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def segment_signature(data_type, llm_type, domain, generator, model):
    """Trimmed type, generator's family, domain and generator (or model), as one struct."""
    t = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.struct(t(F.coalesce(F.nullif(data_type, F.lit("")), F.lit("unknown"))).alias("data_type"), t(llm_type).alias("llm_type"), t(domain).alias("domain"), t(first_filled(generator, model)).alias("generator"))


def instance_id(sentence_id, strategy, shuffled):
    return F.concat_ws("_", sentence_id, strategy, F.substring(F.md5(F.encode(shuffled, "UTF-8")), 1, 8))


def is_refusal(text):
    """Holds one of the phrases in which a model declines."""
    return F.coalesce(text, F.lit("")).rlike("(?i)(?:" + "|".join(REFUSALS) + ")")


def without_reference_numbers(text):
    return F.regexp_replace(text, REFERENCE_NUMBER, "")


def plain_quotes(text):
    return F.translate(text, *QUOTES)


def tidy_space(text):
    """Runs of blanks become one, three line ends or more two, both ends are trimmed."""
    c = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0b]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def without_emphasis(text):
    """Paired and bare markers of bold and italic become blanks."""
    c = F.regexp_replace(F.regexp_replace(text, r"(?s)\*\*(.+?)\*\*", " $1 "), r"(?s)__(.+?)__", " $1 ")
    c = F.regexp_replace(c, r"(?s)(?<!\n)\*(?!\s)(.+?)(?<!\s)\*(?!\w)", " $1 ")
    c = F.regexp_replace(F.regexp_replace(c, r"\*{2,}|_{2,}", " "), r"[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def mostly_nonword(text):
    """Fewer letters and digits than 10 or a twentieth of the length."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) < F.greatest(F.lit(10), F.floor(F.length(text) * 0.05))


def sentences(text):
    """Split after . ! or ? and white space; blank pieces go."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\r\n]+"), lambda s: F.trim(s) != "")


def raw_words(text):
    """Words as they are written, between any white space."""
    return words(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def natural_key(name):
    """A sort key in which runs of digits count as numbers of any length: leading zeros go, and each run stands behind its length in ten places."""
    number = lambda x: F.regexp_replace(x, "^0+", "")
    keyed = lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(x)).cast("string"), 10, "0"), number(x))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), keyed), "")


def parse_option(option):
    """name, strength: split at the last underscore; a strength that is no number is 0, as is a missing one."""
    at = F.regexp_extract(option, r"^(.*)_([^_]*)$", 2)
    whole = ~option.contains("_")
    return F.struct(F.when(whole, option).otherwise(F.regexp_extract(option, r"^(.*)_([^_]*)$", 1)).alias("name"), F.when(whole, 0.0).otherwise(F.coalesce(at.try_cast("double"), F.lit(0.0))).alias("strength"))


def dataset_name(file):
    """dataset, seed, split of a file's name: 'x-test' is the test set, 'x-seed7-train' a training set; any other is 'other' without a seed."""
    name = F.regexp_replace(file, r"\.jsonl", "")
    train = r"^(.*)-seed(\d+)-train$"
    is_test, is_train = name.endswith("-test"), name.rlike(train)
    return F.struct(
        F.when(is_test, F.regexp_replace(name, "-test$", "")).when(is_train, F.regexp_extract(name, train, 1)).otherwise(name).alias("dataset"),
        F.when(is_test, "fixed").when(is_train, F.regexp_extract(name, train, 2)).alias("seed"),
        F.when(is_test, "test").when(is_train, "train").otherwise("other").alias("split"),
    )


def raw_pair_name(file):
    """prefix, split of 'x_train.json' and 'x_test.json'; both null for other names."""
    name = r"^(.*)_(train|test)\.json$"
    return F.struct(F.nullif(F.regexp_extract(file, name, 1), F.lit("")).alias("prefix"), F.nullif(F.regexp_extract(file, name, 2), F.lit("")).alias("split"))


# By what a metric is divided for a figure, which ones a figure of pairs leaves out, and short names of models.
DIVISORS = {"ManhattanDist": 100.0, "EuclideanDist": 10.0, "AvgSentenceLenDiff": 30.0}
LEFT_OUT = ("AvgSentenceLenDiff", "SentenceCountDiff", "TokenOverlap", "POSOverlap")
MODEL_NAMES = {
    "t5-small_group_": ("S", "Small"),
    "t5-base_group_": ("B", "Base"),
    "t5-large_group_": ("L", "Large"),
    "t5-base_random_": ("R", "R"),
    "t5-base_reorder_": ("r", "r"),
    "t5-base_tau_": ("b", "b"),
}


def scaled_metric(metric, value):
    """A pair's metric on the scale of figures."""
    c = F.when(F.lit(False), value)
    for name, by in DIVISORS.items():
        c = c.when(metric == name, value / by)
    return c.otherwise(value)


def scaled_delta(metric, delta):
    return F.when(metric == "HierarchicalDensity", delta * 10).otherwise(delta)


def model_label(model, long: bool = False):
    for name, labels in MODEL_NAMES.items():
        model = F.replace(model, F.lit(name), F.lit(labels[long]))
    return model
