"""Entry 1 of the reference ("price one listing", batch of up to 100) as one DataFrame plan over any
number of listings: validate -> clean -> date defaults -> live tier -> features -> three quantile models
(or, if the caller asks for it, the rule predictor) -> post-process -> nested record.

The plan is narrow (no shuffle): every lookup is a literal map or a broadcast of a fixed table, and the
tree ensembles travel with the tasks. It is stateless, so the same function prices a streaming
DataFrame (see ``baleprice.streaming``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baleprice.operators import clean as C
from baleprice.operators import features as FE
from baleprice.operators import rules as RU
from baleprice.operators import scoring as SC


def price_listings(requests: DataFrame, bundle=None, as_of="listed_at", api_shape: bool = True,
                   keep: list[str] | None = None, rule_model: bool = False) -> DataFrame:
    """Price every valid request; rejected rows come back with ``is_valid = false`` and their
    ``errors`` and no price (the reference rejects the whole batch; we reject per row).

    ``bundle`` is a fitted model with ``score``. Without one the call is refused, unless ``rule_model`` asks for the rule
    predictor; the column ``predictor`` says which of the two priced a row (``model`` or ``rule``).

    ``as_of`` is a column (or literal timestamp) standing for the request time: month and weekday
    default from it (Python convention)."""
    if bundle is None and not rule_model:
        raise ValueError("no model to price with: give a bundle, or rule_model=True for rule prices")
    checked = C.validate_listings(requests)
    if isinstance(as_of, str) and as_of not in checked.columns:
        as_of = F.current_timestamp()
    dated = C.resolve_dates(checked, as_of, "python")
    cleaned = RU.tier_live(C.clean_listings(dated, "v2"))
    if bundle is not None:
        feats = FE.v2_features(cleaned, drop_inputs=False)
        predicted = bundle.score(feats)
    else:
        predicted = SC.rule_predictions(cleaned)
    post = SC.postprocess_range(predicted, "v2")
    nested = SC.nest_response(post, "v2", api_shape=api_shape)
    out_cols = (keep or []) + ["is_valid", "errors", "predictor", "response"]
    nested = nested.withColumn("predictor", F.lit("rule" if bundle is None else "model"))
    return nested.withColumn("response", F.when(F.col("is_valid"), F.col("response"))).select(*out_cols)


def predict_or_fallback(requests: DataFrame, bundle_path: str, keep: list[str] | None = None) -> DataFrame:
    """price with the saved model bundle; when there is none at the path, every row gets the rule-based
    fallback price (E9/E10/E12) with ``is_fallback = true`` and the load error as ``fallback_reason``. Other errors of
    loading (storage, a broken bundle) are raised.
    The fallback needs the v1 client fields (consistency_score, month, market_demand_index); requests
    without them raise instead (the live service answers 503 when no model is loaded)."""
    from baleprice.operators.clean import resolve_dates
    from baleprice.operators.rules import fallback_price
    from baleprice.operators.train import RangeModelBundle
    try:
        bundle = RangeModelBundle.load(bundle_path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        if "listed_at" in requests.columns:  # an absent month is that of the request's date
            requests = resolve_dates(requests, "listed_at", "js")
        missing = {"consistency_score", "month", "market_demand_index"} - set(requests.columns)
        if missing:
            # v2 requests carry no fallback inputs: like the live service (503), refuse to price
            raise RuntimeError(f"model not loaded and requests lack fallback fields {sorted(missing)}") from exc
        reason = f"model bundle unavailable: {type(exc).__name__}"
        return fallback_price(requests, reason=reason)
    return price_listings(requests, bundle=bundle, keep=keep).withColumn("is_fallback", F.lit(False))
