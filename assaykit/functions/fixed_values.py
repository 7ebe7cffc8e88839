"""Word lists, patterns, formats and thresholds that results depend on."""

# Text that a reader turns into a null.
READER_NULL_TOKENS = [
    "", "NULL", "null", "None", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN",
    "-nan", "1.#IND", "1.#QNAN", "<NA>", "NA", "NaN", "nan",
]

# Text that cleaning turns into a null.
CLEAN_NULL_TOKENS = ["", "NULL", "null", "None"]

# Text left behind by a failed text conversion; also a null after trimming.
RESIDUE_TOKENS = ["nan", "None"]

# Separators tried for delimited text, in order.
SEPARATORS = [",", ";", "\t", "|"]

# Patterns by semantic type, matched case-insensitively over the whole value.
PATTERNS = {
    "email": [r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"],
    "phone": [
        r"^\+?1?[-.\s]?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})$",
        r"^\+?[1-9]\d{1,14}$",
    ],
    "url": [
        r"^https?://(?:[-\w.])+(?:\:[0-9]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:\#(?:[\w.])*)?)?$"
    ],
    "uuid": [r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"],
    "currency": [
        r"^\$?[\d,]+\.?\d*$",
        r"^[\d,]+\.?\d*\s?(USD|EUR|GBP|JPY|CAD|AUD)$",
    ],
    "percentage": [r"^\d+\.?\d*%$"],
    "postal_code": [r"^\d{5}(-\d{4})?$", r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$", r"^\d{4,6}$"],
    "ip_address": [
        r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$"
    ],
    "credit_card": [r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"],
    "social_security": [r"^\d{3}-?\d{2}-?\d{4}$"],
}

# Order in which equal scores are resolved: the earlier type wins.
TYPE_ORDER = [
    "email", "phone", "url", "uuid", "currency", "percentage", "postal_code", "ip_address",
    "credit_card", "social_security", "integer", "float", "boolean", "date", "datetime", "json",
    "categorical",
]

# The same types with the parsed ones ahead of the patterns.
TYPE_ORDER_NUMERIC_FIRST = [
    "integer", "float", "boolean", "date", "datetime", "email", "phone", "url", "uuid", "currency",
    "percentage", "postal_code", "ip_address", "credit_card", "social_security", "json",
    "categorical",
]

INTEGER_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"
FLOAT_PATTERN = r"^\s*[+-]?(\d+\.\d*|\.\d+)(e[+-]?\d+)?\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"
JSON_SCALAR_PATTERN = r"^\s*(-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)\s*$"

BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n"]
TRUE_WORDS = ["true", "yes", "1", "y"]
FALSE_WORDS = ["false", "no", "0", "n"]
LOOSE_BOOLEAN_WORDS = ["true", "false", "1", "0"]

# (shape of the text, Spark format) per date and datetime format. The shape is checked first so
# that the parser only sees text it can read.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
]
DATETIME_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$",
     "yyyy-M-d H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?$",
     "yyyy-M-d'T'H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z$", "yyyy-M-d'T'H:m:s'Z'"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/yyyy H:m:s"),
]

# Types whose length is profiled, and types whose range is.
LENGTH_TYPES = ["string", "email", "phone", "url"]
NUMERIC_TYPES = ["integer", "float"]

TYPE_ACCEPTANCE = 0.8
CATEGORY_RATIO = 0.1
CATEGORY_DISTINCT = 50
TOP_CATEGORIES = 20
SAMPLE_VALUES = 10
RULE_VALUES = 1000

# Quality bands, best first.
LEVELS = [("excellent", 0.9), ("good", 0.8), ("fair", 0.6)]
LOWEST_LEVEL = "poor"
VALID_SCORE = 0.6
ROUTE_SCORE = 0.8

# Factors a failed check multiplies the field score by.
FACTORS = {"type": 0.5, "short": 0.7, "long": 0.8, "range": 0.7, "category": 0.9, "pattern": 0.6}
MISSING_REQUIRED, MISSING_OPTIONAL, NULL_OPTIONAL = 0.0, 0.8, 0.9

# The same for the constraint check of inferred definitions.
CONSTRAINT_FACTORS = {"type": 0.8, "length": 0.7, "range": 0.5, "category": 0.6}

ISSUE_TYPES = [
    "missing_value", "invalid_format", "out_of_range", "inconsistent_pattern", "duplicate_value",
    "outlier", "encoding_issue", "length_violation",
]

SEGMENTS = [
    "Healthcare", "Government", "Corporate", "Hospitality", "Retail", "Education", "Finance",
]

# Static customer record: (field, required, min length, max length).
CUSTOMER_MODEL = [
    ("customer_id", True, 1, 10),
    ("company_name", True, 1, 200),
    ("contact_name", True, 1, 100),
    ("contact_title", True, 1, 100),
    ("city", True, 1, 50),
    ("region", False, None, 50),
    ("postal_code", True, 1, 20),
    ("country", True, 2, 50),
    ("segment", True, None, None),
    ("metro_area", True, None, None),
]
CUSTOMER_ALIASES = {
    "customer_id": "CustomerID", "company_name": "CompanyName", "contact_name": "ContactName",
    "contact_title": "ContactTitle", "city": "City", "region": "Region",
    "postal_code": "PostalCode", "country": "Country", "segment": "Segment",
    "metro_area": "MetroArea",
}

# Storage type per semantic type; anything else is a string.
STORAGE_TYPES = {
    "integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp",
    "date": "date", "string": "string", "text": "string", "email": "string", "phone": "string",
    "url": "string", "uuid": "string", "json": "string", "array": "string",
}

# System columns of a structured store; user fields of these names are skipped.
SYSTEM_COLUMNS = [
    "id", "job_id", "source_file", "row_index", "validation_status", "quality_score",
    "ingestion_time",
]

# Keys preferred when an API payload is an object.
PAYLOAD_KEYS = ["records", "data", "results"]

# Records per second from which throughput is high, under which it is low, and what is said about it.
THROUGHPUT_HIGH, THROUGHPUT_LOW = 1000, 100
THROUGHPUT_TEXTS = ["High processing throughput achieved", "Low processing throughput - consider optimization"]

# Encoding labels and the names readers take, the first that any file needs.
READER_ENCODINGS = {"utf-16": "UTF-16", "cp1252": "windows-1252", "latin-1": "ISO-8859-1", "utf-8": "UTF-8"}

READER_FORMATS = {
    "csv": "csv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "xml": "xml",
    "tsv": "delimited", "txt": "delimited", "dat": "delimited",
}
