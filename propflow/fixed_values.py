"""Values that results depend on: labels, templates, term lists, limits."""

# Identifiers of the source data.
CROSSWALK_SOURCE = "EPA DSSTox"
STRUCTURE_PROPERTY = "PUBCHEM_OPENEYE_CAN_SMILES"
LICENSE_RULE = "ContractualRules/LicenseAttribution"

# Labels of the two measured endpoints.
ENDPOINT_LABELS = {
    "4_hr_value_mgL": (
        "Lethal concentration where 50% of the population dies during a 4-hour exposure"
        " of inhalation, AKA 4hr_LC50 (mg/L)"
    ),
    "4_hr_value_ppm": (
        "Parts of the chemical per million where 50% of the population dies during a"
        " 4-hour exposure of inhalation, AKA 4hr_LC50 (ppm)"
    ),
}
ENDPOINT_QUESTIONS = {
    "4_hr_value_mgL": "What is the acute inhalation LC50 of this compound in mg/L?",
    "4_hr_value_ppm": "What is the acute inhalation LC50 of this compound in ppm?",
}

# Snippet scoring terms.
SNIPPET_TERMS = ["acute", "inhalation", "toxicity", "lc50"]
SNIPPET_PHRASES = ["inhalation lc50", "acute inhalation toxicity"]
SNIPPET_STRONG_UNITS = ["ppm"]
SNIPPET_WEAK_UNITS = ["mg/l", "mg/m3"]
SNIPPET_DURATIONS = ["4 hour", "4-hour"]
SNIPPET_SHORT = 100
SNIPPET_WINDOW = 500
SNIPPET_TOP = 5

# Limits and thresholds.
CONTEXT_CAP = 120_000
CONTEXT_SUFFIX = "... (truncated)"
PACK_LIMITS = (1024, 256, 256)
PAD_LENGTH = 120
CONFIDENCE_THRESHOLDS = [5, 6, 7, 8]
CONFIDENCE_GAP = 1.5
DECILES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
LITRES_PER_MOLE = 24.45
VOCAB_SPECIALS = ["<pad>", "<sos>", "<eos>"]
SEPARATOR_SYMBOLS = ["<property>", "<value>"]

# Prompt templates, filled by `format_string` (%s only).
EXEMPLAR_HEADER = (
    "Below is a table of chemicals and their acute inhalation LC50 values in mg/m^3 and ppm.\n\n"
    "Chemical\t4hr LC50 (mg/m^3)\t4hr LC50 (ppm)\n"
    "--------\t----------------\t------------\n"
)
SUMMARY_PROMPT = (
    "The below information describes %1$s:\n%2$s\n\n summarize this information to support"
    " estimation of the acute inhalation LC50 value for a 4-hour exposure of %1$s in mg/m^3"
    " and ppm."
)
ESTIMATE_PROMPT = (
    "%1$s\n\n%2$s\n\n"
    "Estimate the rat numeric acute inhalation LC50 value for a 4-hour exposure of %3$s "
    "in both milligrams per cubic meter and parts per million.\n"
    "Apply a margin of safety estimating a value that's what rat experiment suggests"
)
DIGEST_HEAD = "For the chemical with DTXSID %s, here are the details:\nHeadings:\n"
DIGEST_MIDDLE = "\nDetails:\n"
DIGEST_TAIL = (
    "\n\nQuestion: What is the median lethal concentration (LC50) for a chemical substance,"
    " measured over a 4-hour exposure period and expressed in milligrams per liter (mg/L)?"
)
SNIPPET_PROMPT = (
    "use what you know, and the below text blobs to estimate \n"
    "    the 4-hour human inhalation LC50 value of %1$s with cas %2$s in ppm.\n%3$s"
)
NAME_QUESTION = "what is the 4-hour inhalation LC50 value of %s in mg/L"
SEARCH_QUERY = '"%s" "acute" "inhalation" "LC50" "ppm"'
TRAINING_TEXT = "%s <property> %s <value> %s"
