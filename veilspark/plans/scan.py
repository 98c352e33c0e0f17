"""Scan plans: detect, propagate, merge and redact in one narrow projection.

Every step is local to a document, so a scan has no exchange at any scale; the
findings stay an array column until they are reported.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.rowsql import column
from veilspark.operators.admit import norm_depth
from veilspark.operators.hooks import model_findings
from veilspark.operators.lexicon import LEXICON_RULES, Lexicon, detect_lexicon, entities_sql, with_lexicon, with_listed
from veilspark.operators.merge import combine, cover_findings, merge_findings
from veilspark.operators.propagate import with_propagated
from veilspark.operators.redact import layer_count, redact
from veilspark.operators.rules import Rule, detect_sql, no_findings, sort_by_start
from veilspark.operators.secrets import ALLOWED_VALUES, SECRET_RULES, SecretRule, detect_secrets
from veilspark.operators.structured import pattern_rules
from veilspark.schema import FINDINGS, NO_FINDINGS, PATTERN


@dataclass(frozen=True)
class ScanOptions:
    """What a scan looks for and how it resolves overlaps.

    `models` maps a layer name (`pattern` or `lexicon`) to a user function over
    pandas text batches; a failing model yields a layer error and the scan goes
    on. `all_occurrences` redacts every place of a secret, `mode="cover"` the
    whole extent of overlapping findings. Secrets are searched at every path unless
    `allowed_paths` names patterns (`secrets.ALLOWED_PATHS`, say); there `n_secret` is NULL.
    The lexicon is a list in the program, or a table `(term, tag)` of any size, with the
    same result; a table is joined to the texts, a list costs no exchange.
    """

    threshold: float = 0.5
    entities: tuple[str, ...] = ()
    lexicon: Lexicon | DataFrame | None = None
    secret_rules: Sequence[SecretRule] = SECRET_RULES
    allowed_values: tuple[str, ...] = ALLOWED_VALUES
    allowed_paths: tuple[str, ...] = ()
    extra_rules: Sequence[Rule] = ()
    lexicon_rules: Sequence[Rule] = LEXICON_RULES
    all_occurrences: bool = False
    mode: str = "greedy"
    models: dict[str, Callable] | None = None


def pattern_layer(text: Column, options: ScanOptions, lexicon: Lexicon | Column | None) -> Column:
    rules = pattern_rules(options.entities) + list(options.extra_rules)
    threshold = f"{options.threshold or 0.5}D"

    def layer(t: str, lexicon_: Lexicon | str | None) -> str:
        found = detect_sql(t, rules, PATTERN, threshold)
        if lexicon_ is None:
            return found
        return sort_by_start(f"concat({found}, {entities_sql(t, lexicon_, options.entities)})")

    return with_lexicon(layer, text, lexicon)


def detect_layers(
    df: DataFrame,
    text: str = "text",
    depth: str | Column = "quick",
    options: ScanOptions = ScanOptions(),
    path: Column | None = None,
) -> DataFrame:
    """Add `depth` and one findings array per layer (`f_secret`, `f_pattern`,
    `f_lexicon`; NULL when a row's depth skips the layer) plus `layer_errors`.

    With a constant depth the layers that do not run are not in the plan at all;
    with a column each row runs only its own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    fixed = depth if isinstance(depth, str) else None
    level = norm_depth(F.lit(fixed) if fixed is not None else depth)
    if fixed is not None and fixed not in ("standard", "deep"):
        fixed = "quick"
    skipped = F.lit(None).cast(FINDINGS)

    def gated(layer: Callable[[], Column], depths: tuple[str, ...]) -> Column:
        if fixed is not None:
            return layer() if fixed in depths else skipped
        return F.when(F.col("depth").isin(*depths), layer()).otherwise(skipped)

    out, lexicon = df.withColumn("depth", level), options.lexicon
    if isinstance(lexicon, DataFrame):
        if fixed != "quick":
            # rows that skip both layers send no text
            out = out.withColumn("_looked_up", F.when(F.col("depth") != "quick", body))
            out = with_listed(out, lexicon, "_looked_up").drop("_looked_up")
        lexicon = F.col("_listed")
    columns = {
        "f_secret": detect_secrets(body, options.secret_rules, options.allowed_values, options.all_occurrences, path, options.allowed_paths),
        "f_pattern": gated(lambda: pattern_layer(body, options, lexicon), ("standard", "deep")),
        "f_lexicon": gated(lambda: detect_lexicon(body, lexicon, options.lexicon_rules), ("deep",)),
        "layer_errors": F.lit(None).cast("map<string,string>"),
    }
    out = out.withColumns(columns)
    out = out.drop("_listed")
    for layer, model in (options.models or {}).items():
        depths = ("standard", "deep") if layer == PATTERN else ("deep",)
        out = _add_model(out, body, layer, model, depths)
    return out


def _add_model(df: DataFrame, body: Column, layer: str, model: Callable, depths: tuple[str, ...]) -> DataFrame:
    """Add a user model's findings to its layer. Rows whose depth skips the layer
    send no text. A failed batch leaves the layer empty and reports the error."""
    name = f"f_{layer}"
    called = df.withColumn("_m", model_findings(model, layer)(F.when(F.col("depth").isin(*depths), body)))
    error = F.col("_m.error")
    both = F.concat(F.col(name), F.coalesce(F.col("_m.findings"), no_findings()))
    found = column(sort_by_start, findings=both)
    return called.withColumns(
        {
            name: F.when(error.isNull() & F.col(name).isNotNull(), found),
            "layer_errors": F.when(
                error.isNotNull(),
                F.map_concat(F.coalesce(F.col("layer_errors"), F.create_map().cast("map<string,string>")), F.create_map(F.lit(layer), error)),
            ).otherwise(F.col("layer_errors")),
        }
    ).drop("_m")


def resolve(df: DataFrame, text: str = "text", mode: str = "greedy") -> DataFrame:
    """Layer arrays -> `f_crossref`, `findings` (merged), `sanitized` and counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = combine(F.col("f_secret"), F.col("f_pattern"), F.col("f_lexicon"))
    merge = merge_findings if mode == "greedy" else cover_findings
    # rows of other depths have nothing to propagate
    deep = F.when(F.col("depth") == "deep", F.col("_raw")).otherwise(F.expr(NO_FINDINGS))
    propagated = with_propagated(df.withColumn("_raw", raw).withColumn("_deep", deep), body, "_deep", "f_crossref").drop("_deep")
    return (
        propagated.withColumn("f_crossref", F.when((F.col("depth") == "deep") & (F.size("_raw") > 0), F.col("f_crossref")))
        .withColumn("findings", merge(combine(F.col("_raw"), F.col("f_crossref"))))
        .withColumns(
            {
                "sanitized": redact(body, F.col("findings")),
                "n_findings": F.size("findings"),
                "n_secret": layer_count(F.col("f_secret")),
                "n_pattern": layer_count(F.col("f_pattern")),
                "n_lexicon": layer_count(F.col("f_lexicon")),
                "n_xref": layer_count(F.col("f_crossref")),
            }
        )
    )


RESULT = ("depth", "sanitized", "n_findings", "n_secret", "n_pattern", "n_lexicon", "n_xref", "layer_errors", "findings")


def scan(
    df: DataFrame,
    depth: str | Column = "quick",
    id: str = "doc_id",
    text: str = "text",
    options: ScanOptions = ScanOptions(),
    keep: Iterable[str] = (),
    path: Column | None = None,
) -> DataFrame:
    """Scan a table of texts.

    `depth` is one of the three names, or a column for a depth per row. The
    result has the id, the `keep` columns and RESULT; the input text is not part
    of it. Rows without text or over the size limit belong to `split_admitted`.
    """
    kept = [c for c in dict.fromkeys((id, *keep)) if c not in RESULT]
    base = df.select(*dict.fromkeys((*kept, text)), *([] if isinstance(depth, str) else [depth.alias("depth")]))
    level = depth if isinstance(depth, str) else F.col("depth")
    layers = detect_layers(base, text, level, options, path)
    return once(resolve(layers, text, options.mode), kept)


def once(resolved: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The result behind a generator of one row, which later filters and joins on it don't get below.

    Without it, Spark copies the whole scan into every such condition.
    """
    packed = resolved.select(*kept, F.explode_outer(F.array(F.struct(*RESULT))).alias("_scan"))
    return packed.select(*kept, *[F.col(f"_scan.{c}").alias(c) for c in RESULT])
