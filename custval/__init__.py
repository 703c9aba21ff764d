"""custval: customer analytics (RFM, CLV, BG/NBD, Gamma-Gamma) on Spark DataFrames.

Main entry points::

    from custval import rfm_retail, clv_formula_retail, clv_predict_retail
    from custval import rfm_omni, clv_predict_omni, qcut, qcut_many, Cut
"""

from custval.operators.bgnbd import BetaGeoModel
from custval.operators.gammagamma import GammaGammaModel
from custval.operators.quantiles import Cut, qcut, qcut_many, qcut_rank_first
from custval.plans.omni import brand_campaign, campaign_targets, data_prep, discount_campaign, rfm_omni
from custval.plans.predict import clv_predict, clv_predict_omni, clv_predict_retail
from custval.plans.retail import clv_formula_retail, rfm_retail
from custval.session import clear_materialized, get_spark, materialize

__all__ = [
    "BetaGeoModel",
    "Cut",
    "GammaGammaModel",
    "brand_campaign",
    "campaign_targets",
    "clear_materialized",
    "clv_formula_retail",
    "clv_predict",
    "clv_predict_omni",
    "clv_predict_retail",
    "data_prep",
    "discount_campaign",
    "get_spark",
    "materialize",
    "qcut",
    "qcut_many",
    "qcut_rank_first",
    "rfm_omni",
    "rfm_retail",
]
