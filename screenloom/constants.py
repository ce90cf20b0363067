"""Values that decide results.  Everything here is data, nothing is logic."""

# --- Fixed values: they must equal the screened method's own settings ---------

SEED = 42

KEY, LABEL, SOURCE, ROW_ID = "smiles", "label", "source", "row_id"

TRAIN_RATIO, VAL_RATIO, TEST_RATIO = 0.70, 0.15, 0.15
RATIO_TOLERANCE = 0.01
MIN_CLEAN_ROWS = 100
MIN_SPLIT_ROWS = 30
IMBALANCE_WARNING = 3.0

FP_RADIUS = 2
FP_BITS = 2048
DESCRIPTOR_NAMES = [
    "MolWt",
    "LogP",
    "HBD",
    "HBA",
    "TPSA",
    "RotatableBonds",
    "RingCount",
    "AromaticFraction",
    "FractionCSP3",
]
FEATURE_MODES = ("fingerprint", "descriptors", "combined")

CV_FOLDS = 5
DEFAULT_THRESHOLD = 0.5

# Threshold grid: 80 doubles, GRID_START + i * GRID_STEP for i = 0..79.
GRID_START = 0.1
GRID_STEP = 0.009999999999999995
GRID_SIZE = 80

CALIBRATION_BINS = 10

HIGH_RISK, MODERATE_RISK = 0.7, 0.4
HIGH_CONFIDENCE, MODERATE_CONFIDENCE = 0.3, 0.15

WEIGHT_MIN, WEIGHT_MAX = 100.0, 900.0
SMALL_ENTITY_ATOMS = 5

LIMIT_WEIGHT, LIMIT_LOGP, LIMIT_HBD, LIMIT_HBA = 500, 5, 5, 10
ALERT_LOGP, ALERT_TPSA_HIGH, ALERT_TPSA_LOW, ALERT_ROTATABLE = 3, 140, 20, 10

FOREST_TREES = 200
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.05

GLOBAL_TOP, LOCAL_TOP, LOCAL_DISPLAY = 20, 15, 10
SAMPLE_ROWS = 100

KEY_COLUMN_ALIASES = ("smiles", "smi", "molecule", "drug")

# Boosted trees / logistic regression / random forest settings.
BOOSTED = {
    "n_estimators": 300,
    "max_depth": 6,
    "learning_rate": 0.1,
    "subsample": 0.8,
    "colsample": 0.8,
    "min_child_weight": 3,
    "gamma": 0.1,
}
LOGISTIC = {"C": 1.0, "max_iter": 1000}
FOREST = {"n_estimators": 200, "max_depth": 10}

SEARCH_SPACE = {
    "n_estimators": [100, 200, 300, 500],
    "max_depth": [3, 4, 5, 6, 8],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "min_child_weight": [1, 3, 5, 7],
    "gamma": [0, 0.1, 0.2, 0.5],
}
SEARCH_DRAWS = 50

# Texts shown to the reader of a result.
TOXIC, NON_TOXIC = "Toxic", "Non-Toxic"
IN_DOMAIN, OUT_OF_DOMAIN, UNKNOWN_DOMAIN = "In-Domain", "Out-of-Domain", "Unknown"

MSG_INVALID = "Invalid SMILES string. Cannot make prediction."
MSG_WEIGHT_LOW = (
    "Molecular weight (%.1f Da) is below typical drug range (100.0–900.0 Da). "
    "Prediction may be less reliable."
)
MSG_WEIGHT_HIGH = (
    "Molecular weight (%.1f Da) is above typical drug range (100.0–900.0 Da). "
    "Prediction may be less reliable."
)
MSG_SMALL = "Very small molecule (%d heavy atoms). Prediction confidence may be low."
MSG_UNPARSED = "Could not parse SMILES for domain check."
MSG_FEATURES = "Feature generation failed for this molecule."
MSG_DOMAIN = (
    "Structure is distant from the training distribution. "
    "Prediction confidence may be lower."
)
MSG_BOUNDARY = (
    "Prediction is near the decision boundary. "
    "Experimental validation is recommended."
)

ALERT_VIOLATIONS = (
    "Lipinski Rule of 5: %d violations (Potential poor oral bioavailability)"
)
ALERT_HIGH_LOGP = (
    "High Lipophilicity: LogP > 3 (Commonly associated with metabolic instability "
    "and off-target toxicity)"
)
ALERT_HIGH_TPSA = "High TPSA: > 140 Å² (Likely poor membrane permeability)"
ALERT_LOW_TPSA = (
    "Low TPSA: < 20 Å² (May correlate with high blood-brain barrier penetration "
    "or non-specific binding)"
)
ALERT_FLEXIBLE = (
    "High Flexibility: > 10 rotatable bonds (Veber's Rule: may impact oral "
    "bioavailability)"
)
ALERT_NITRO = (
    "Structural Alert: Nitro group detected (Potential mutagenicity/toxicity risk)"
)
ALERT_RING_AMINE = (
    "Structural Alert: Primary aromatic amine detected (Potential metabolic "
    "activation to reactive intermediates)"
)
SUMMARY_CLEAR = "Medicinal chemistry profile looks standard."
SUMMARY_ALERTS = "Detected %d medicinal chemistry alerts."

NOTE_ACTIVE_BIT = "Approximate mapping (hashed fingerprint)"
NOTE_INACTIVE_BIT = "Bit not active in this molecule"

BATCH_COLUMNS = [
    "input_smiles",
    "canonical_smiles",
    "is_valid",
    "prediction",
    "probability",
    "risk_level",
    "confidence",
    "ad_status",
    "alerts",
    "warnings",
]

COMPARISON_METRICS = [
    "cv_roc_auc_mean",
    "cv_f1_mean",
    "cv_precision_mean",
    "cv_recall_mean",
]

# Cell texts a CSV reader treats as missing.
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Standard atomic weights of the elements that occur in drug-like molecules.
ATOMIC_WEIGHTS = {
    "H": 1.008,
    "B": 10.81,
    "C": 12.011,
    "N": 14.007,
    "O": 15.999,
    "F": 18.998,
    "Na": 22.990,
    "Mg": 24.305,
    "Al": 26.982,
    "Si": 28.085,
    "P": 30.974,
    "S": 32.06,
    "Cl": 35.45,
    "K": 39.098,
    "Ca": 40.078,
    "Fe": 55.845,
    "Co": 58.933,
    "Cu": 63.546,
    "Zn": 65.38,
    "As": 74.922,
    "Se": 78.971,
    "Br": 79.904,
    "Ag": 107.868,
    "I": 126.904,
    "Pt": 195.084,
    "Au": 196.967,
    "Hg": 200.592,
}
HYDROGEN_WEIGHT = 1.008
