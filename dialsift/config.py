"""Driver-side settings for a run: seeds, thresholds and column names."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the reference's for the same results.
PERIODS = ("3UM", "6UM", "9UM", "12UM")
DROP_COLUMNS = ("CODIGO", "dfechNac", "GRUPO_CAPITAL", "PERIODO")
CATEGORY_FILL = {"GEnero": "Desconocido", "Estado_civil": "Desconocido"}
MEDIAN_FILL = ("Edad", "dias_mora_cartera")
CATEGORICAL = ("GEnero", "Estado_civil", "FLAG_DEPENDIENTE", "producto_cat", "GRUPO_CANAL")
CORRELATION_THRESHOLD = 0.95
MILESTONES = (50, 80, 95, 99, 100)
TOPK_SHARES = (10, 20, 50)
BUSINESS_WEIGHTS = (0.50, 0.30, 0.20)  # capital, age, dependent
EPS_RATIO = 1e-6
MIN_PRECISION_RECALL_PICK = 0.10
MIN_RECALL_AUC_PICK = 0.50
MIN_PRECISION_TUNING = 0.15
RANDOM_STRATEGY = "Aleatorio"
BUSINESS_STRATEGY = "Criterio_Empresarial"


FEATURE_TYPES = ("ratio", "trend", "density", "interaction", "aggregation")


@dataclass
class RunConfig:
    """Settings of prepare and evaluate; the defaults are the reference's."""

    seed: int = 42
    target: str = "CD"
    key: str = "CODIGO"
    test_size: float = 0.2
    stratify: bool = True
    feature_types: tuple[str, ...] = FEATURE_TYPES  # () switches feature engineering off
    fit_on: str = "all"  # imputation, categories and pruning fitted on "all" rows or on "train" rows only
    undersample_ratio: float = 0.5
    smote_k: int = 5
    cv_folds: int = 2  # of the tuning of the three picks
    tuning_iter: int = 150
    zoo_parallelism: int | None = None  # fits at once; None: after the training sets' size
