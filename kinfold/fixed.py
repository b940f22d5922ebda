"""Names, domains and constants that tables written for this kind of
evaluation already use, so that such tables load unchanged. Everything here is plain data."""

from __future__ import annotations

# --- fixed values: manifest columns, defaults and allowed values -------------
REQUIRED_COLUMNS = ("image_path", "species", "isolate_id", "modality")
OPTIONAL_DEFAULTS = {"view": "na", "device": "unknown", "day": "", "source": "cmu"}
ALLOWED_VALUES = {
    "modality": ("colony", "microscopic"),
    "view": ("obverse", "reverse", "na"),
    "device": ("microscope_camera", "smartphone", "unknown"),
    "source": ("cmu", "openfungi"),
}
GROUP_REQUIRED_SOURCES = ("cmu",)
SINGLETON_PREFIX = "img:"

# --- fixed values: prediction table ------------------------------------------
PREDICTION_COLUMNS = ("image_path", "species", "isolate_id", "modality", "view", "device", "day", "source")
SCORE_PREFIX = "prob_"

# --- fixed values: report keys -----------------------------------------------
ITEM_LEVEL = "image_level"
GROUP_LEVEL = "isolate_level"
RATIO_METRICS = ("sensitivity", "specificity", "ppv", "npv", "f1", "accuracy_ovr")
CLASS_METRICS = RATIO_METRICS + ("auc",)
COMPARED_METRICS = ("sensitivity", "specificity", "ppv", "npv", "f1", "auc")
INTERVAL_KEY = "ci95_isolate_bootstrap"
STRATIFIED_METHOD = "isolates within class"
POOLED_METHOD = "isolates"

# --- fixed values: parameter choices -----------------------------------------
SPLIT_STRATEGIES = ("holdout", "kfold", "loio")
IMBALANCE_MODES = ("sampler", "loss", "none")

# --- fixed values: review sheet ----------------------------------------------
REVIEW_COLUMNS = (
    "image_path", "true_species", "predicted", "probability", "panel",
    "reviewer", "concordant_with_morphology", "highlighted_structure", "artifact_suspected", "notes",
)

# --- fixed values: per-channel normalisation (R, G, B) -----------------------
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)

# --- fixed values: defaults and files of a training run ----------------------
N_FOLDS = 5
VAL_FRACTION = 0.2
SEED = 42
REPLICATES = 1000
CONFIG_FILE, PREDICTIONS_FILE, PREDICTIONS_TABLE, REPORT_FILE = "config.json", "predictions.csv", "predictions.parquet", "metrics.json"
MODEL_FOLDER, FOLDS_FOLDER = "model", "folds"
