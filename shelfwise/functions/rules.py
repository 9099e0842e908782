"""Word lists, unit tables and patterns that results depend on, in the order in which they are tried."""

# price text
CURRENCY = r"[$€£¥₹]|USD|EUR|GBP|CAD|AUD"
CURRENCY_MARKS = ["$", "€", "£", "¥", "₹", "USD", "EUR", "GBP", "CAD", "AUD"]
NUMBER = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"

# catalog text cleaning
HTML_TAG = r"<[^>]+>"
# the class is letters, ! and all of ASCII from $ to _, which holds digits, marks and escapes with %
URL = r"https?://[a-zA-Z!$-_]+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"
SPECIAL = [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("–", "-"), ("—", "-"), ("…", "..."), ("®", "(R)"), ("™", "(TM)"), ("©", "(C)")]
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
LABELS = [(r"(?i)Item\s+Name\s*:\s*", "Item Name: "), (r"(?i)Value\s*:\s*", "Value: "), (r"(?i)Unit\s*:\s*", "Unit: "), (r"(?i)Bullet\s+Point\s+(\d+)\s*:\s*", "Bullet Point $1: ")]
MEASURES = [("oz", "ounce"), ("lb", "pound"), ("lbs", "pounds"), ("ft", "feet"), ("in", "inch"), ("ins", "inches"), ("ml", "milliliter"), ("l", "liter"), ("kg", "kilogram"), ("g", "gram"), ("mm", "millimeter"), ("cm", "centimeter"), ("m", "meter")]
TERMS = [(r"\bpcs?\b", "pieces"), (r"\bpkg?\b", "package"), (r"\boz?\b", "ounce"), (r"\blbs?\b", "pound"), (r"\bkgs?\b", "kilogram"), (r"\bgms?\b", "gram"), (r"\bmls?\b", "milliliter"), (r"\blts?\b", "liter")]
NO_DESCRIPTION = "No product description available"
NO_IMAGE = "placeholder_image.jpg"

# the sixteen model inputs
UNIT_SCORES = [("fl oz", 1.0), ("oz", 1.0), ("ounce", 1.0), ("lb", 16.0), ("pound", 16.0), ("kg", 35.27), ("kilogram", 35.27), ("gram", 0.035), ("grams", 0.035), ("g ", 0.035), ("ml", 0.034), ("milliliter", 0.034), ("liter", 33.8), ("litre", 33.8), ("count", 1.0), ("pack", 1.0), ("piece", 1.0), ("pcs", 1.0)]
PACK_PATTERNS = [r"pack\s+of\s+(\d+)", r"\((\d+)\s+pack\)", r"(\d+)\s*(?:count|pcs|pieces|ct\b)", r"set\s+of\s+(\d+)"]
MODEL_BRANDS = ["apple", "samsung", "sony", "lg", "hp", "dell", "nike", "adidas", "amazon", "google", "microsoft", "cisco", "bosch", "philips"]
MODEL_CATEGORIES = [("electronic", 1), ("cable", 1), ("adapter", 1), ("charger", 1), ("food", 2), ("sauce", 2), ("coffee", 2), ("tea", 2), ("snack", 2), ("clothing", 3), ("shirt", 3), ("dress", 3), ("shoes", 3), ("toy", 4), ("game", 4), ("puzzle", 4), ("supplement", 5), ("vitamin", 5), ("protein", 5)]
SIZE_WORDS = ["inch", '"', "cm", "mm", "size"]
WEIGHT_WORDS = ["oz", "lb", "gram", "kg"]
VOLUME_WORDS = ["ml", "liter", "gallon", "fl oz"]

# item pack quantity: pattern, value group, unit group (0: none), confidence, method
_COUNT_UNIT = r"pcs?|pieces?|units?|count|items?"
_SIZE_UNIT = r"g|grams?|kg|kilograms?|oz|ounces?|ml|milliliters?|l|liters?|pcs?|pieces?"
IPQ = [
    (rf"(?i)(?:pack\s+of\s+|quantity\s*:?\s*|qty\s*:?\s*)(\d+(?:\.\d+)?)\s*({_COUNT_UNIT})?", 1, 2, 0.95, "explicit_pack"),
    (rf"(?i)(\d+(?:\.\d+)?)\s*({_COUNT_UNIT})\b", 1, 2, 0.90, "count_with_units"),
    (rf"(?i)(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*({_SIZE_UNIT})?", 1, 0, 0.85, "multiplication"),
    (rf"(?i)(?:size\s*:?\s*|pack\s+size\s*:?\s*)(\d+(?:\.\d+)?)\s*({_SIZE_UNIT})?", 1, 2, 0.80, "size_spec"),
    (rf"\((\d+(?:\.\d+)?)\s*({_SIZE_UNIT})?\)", 1, 2, 0.75, "parenthetical"),
    (r"(?i)(\d+(?:\.\d+)?)\s*(g|grams?|kg|kilograms?|oz|ounces?|lbs?|pounds?|ml|milliliters?|l|liters?|fl\s*oz)\b", 1, 2, 0.88, "weight_volume"),
]
UNITS = [
    ("g", "gram", 1.0), ("gram", "gram", 1.0), ("grams", "gram", 1.0), ("kg", "gram", 1000.0), ("kilogram", "gram", 1000.0), ("kilograms", "gram", 1000.0),
    ("oz", "gram", 28.3495), ("ounce", "gram", 28.3495), ("ounces", "gram", 28.3495), ("lb", "gram", 453.592), ("lbs", "gram", 453.592), ("pound", "gram", 453.592), ("pounds", "gram", 453.592),
    ("ml", "milliliter", 1.0), ("milliliter", "milliliter", 1.0), ("milliliters", "milliliter", 1.0), ("l", "milliliter", 1000.0), ("liter", "milliliter", 1000.0), ("liters", "milliliter", 1000.0),
    ("fl oz", "milliliter", 29.5735), ("fl_oz", "milliliter", 29.5735),
    ("pc", "piece", 1.0), ("pcs", "piece", 1.0), ("piece", "piece", 1.0), ("pieces", "piece", 1.0), ("unit", "piece", 1.0), ("units", "piece", 1.0), ("count", "piece", 1.0), ("item", "piece", 1.0), ("items", "piece", 1.0),
]
PARSER_IPQ = [r"(?:pack\s+of\s+|quantity\s*:?\s*|qty\s*:?\s*)(\d+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s*(?:pcs?|pieces?|units?|count|items?)\b", r"(\d+)\s*x\s*\d+(?:\.\d+)?", r"(?:size\s*:?\s*|pack\s+size\s*:?\s*)(\d+(?:\.\d+)?)"]

# catalog parser
_LENGTH = r"(\d+(?:\.\d+)?)\s*(mm|cm|m|in|inch|inches|ft|feet)"
LENGTHS = [("mm", 0.001), ("cm", 0.01), ("m", 1.0), ("in", 0.0254), ("inch", 0.0254), ("inches", 0.0254), ("ft", 0.3048), ("feet", 0.3048)]
LWH = rf"{_LENGTH}\s*[x×]\s*{_LENGTH}\s*[x×]\s*{_LENGTH}"
LW = rf"{_LENGTH}\s*[x×]\s*{_LENGTH}"
DIAMETER = r"(?:diameter|dia\.?)\s*:?\s*(\d+(?:\.\d+)?)\s*(mm|cm|m|in|inch|inches)"
LABELLED = rf"(length|width|height|depth|diameter)\s*:?\s*{_LENGTH}"
MATERIALS = [
    "cotton|polyester|wool|silk|linen|nylon|spandex|elastane",
    "plastic|metal|steel|aluminum|wood|glass|ceramic|rubber",
    "leather|suede|canvas|denim|fleece|velvet|satin",
    "stainless steel|carbon fiber|titanium|brass|copper",
    "organic|bamboo|hemp|recycled|eco-friendly",
]
COLORS = [
    "red|blue|green|yellow|orange|purple|pink|brown|black|white|gray|grey",
    "navy|maroon|burgundy|teal|turquoise|magenta|cyan|lime|olive",
    "beige|tan|cream|ivory|silver|gold|bronze|copper",
    r"(?:dark|light|bright|pale|deep|vivid)\s+(?:red|blue|green|yellow|orange|purple|pink|brown|gray|grey)",
]
BRANDS = [
    ("apple|samsung|sony|lg|microsoft|google|amazon|dell|hp|lenovo|asus|acer", "technology"),
    ("intel|amd|nvidia|qualcomm|broadcom|cisco|oracle", "technology"),
    ("nike|adidas|puma|under armour|reebok|new balance|converse", "sportswear"),
    ("gucci|prada|louis vuitton|chanel|hermes|versace|armani", "luxury_fashion"),
    ("zara|h&m|uniqlo|gap|old navy|target|walmart", "retail_fashion"),
    ("coca-cola|pepsi|nestle|unilever|procter|johnson|kraft|general mills", "consumer_goods"),
    ("tide|dove|pantene|head shoulders|gillette|oral-b", "personal_care"),
    ("toyota|ford|bmw|mercedes|honda|volkswagen|audi|nissan|hyundai|kia", "automotive"),
    ("ikea|home depot|lowes|wayfair|pottery barn|west elm", "home_furniture"),
]
CATEGORIES = [
    ("phone|smartphone|tablet|laptop|computer|electronics?|gadget", "electronics", 0.9),
    ("shirt|pants|dress|shoes|clothing|apparel|fashion|wear", "clothing", 0.85),
    ("food|snack|beverage|drink|grocery|organic|nutrition", "food_beverage", 0.8),
    ("book|magazine|novel|textbook|literature|reading", "books", 0.9),
    ("toy|game|puzzle|doll|action figure|playset", "toys", 0.9),
    ("furniture|chair|table|sofa|bed|home|decor", "furniture", 0.85),
    ("beauty|cosmetic|skincare|makeup|shampoo|lotion", "beauty", 0.85),
    ("tool|hardware|drill|hammer|screwdriver|wrench", "tools", 0.9),
    ("car|auto|vehicle|tire|engine|automotive|motor", "automotive", 0.85),
    ("health|vitamin|supplement|medicine|medical|wellness", "health", 0.8),
    ("sport|fitness|exercise|gym|workout|athletic", "sports", 0.8),
    ("kitchen|cooking|cookware|appliance|utensil", "kitchen", 0.85),
]
SPECS = [
    ("weight", r"(?:weight|wt\.?)\s*:?\s*(\d+(?:\.\d+)?)\s*(g|grams?|kg|kilograms?|oz|ounces?|lbs?|pounds?)"),
    ("volume", r"(?:capacity|volume|size)\s*:?\s*(\d+(?:\.\d+)?)\s*(ml|milliliters?|l|liters?|fl\s*oz|cups?|pints?|quarts?|gallons?)"),
    ("power", r"(?:power|wattage|watts?)\s*:?\s*(\d+(?:\.\d+)?)\s*(w|watts?|kw|kilowatts?)"),
    ("voltage", r"(?:voltage|volts?)\s*:?\s*(\d+(?:\.\d+)?)\s*(v|volts?|kv)"),
    ("temperature", r"(?:temperature|temp\.?)\s*:?\s*(\d+(?:\.\d+)?)\s*(°?[cf]|celsius|fahrenheit|degrees?)"),
    ("speed", r"(?:speed|rpm)\s*:?\s*(\d+(?:\.\d+)?)\s*(rpm|mph|kmh|km/h)"),
    ("memory", r"(?:memory|ram|storage)\s*:?\s*(\d+(?:\.\d+)?)\s*(gb|mb|tb|gigabytes?|megabytes?|terabytes?)"),
]

# text features
TEXT_BRANDS = [
    ("apple|samsung|sony|lg|microsoft|google|amazon|nike|adidas", "tech_fashion"),
    ("coca-cola|pepsi|nestle|unilever|procter|johnson|kraft", "consumer_goods"),
    ("toyota|ford|bmw|mercedes|honda|volkswagen", "automotive"),
    ("walmart|target|costco|ikea|home depot", "retail"),
]
TEXT_CATEGORIES = [
    ("phone|smartphone|tablet|laptop|computer|electronics?", "electronics"),
    ("shirt|pants|dress|shoes|clothing|apparel|fashion", "clothing"),
    ("food|snack|beverage|drink|grocery|organic", "food_beverage"),
    ("book|magazine|novel|textbook|literature", "books"),
    ("toy|game|puzzle|doll|action figure", "toys"),
    ("furniture|chair|table|sofa|bed|home", "furniture"),
    ("beauty|cosmetic|skincare|makeup|shampoo", "beauty"),
    ("tool|hardware|drill|hammer|screwdriver", "tools"),
    ("car|auto|vehicle|tire|engine|automotive", "automotive"),
    ("health|vitamin|supplement|medicine|medical", "health"),
]
COLOR_RGB = [
    ("red", 1.0, 0.0, 0.0), ("blue", 0.0, 0.0, 1.0), ("green", 0.0, 1.0, 0.0), ("yellow", 1.0, 1.0, 0.0), ("orange", 1.0, 0.5, 0.0), ("purple", 0.5, 0.0, 0.5), ("pink", 1.0, 0.5, 0.5), ("brown", 0.6, 0.3, 0.1),
    ("black", 0.0, 0.0, 0.0), ("white", 1.0, 1.0, 1.0), ("gray", 0.5, 0.5, 0.5), ("silver", 0.7, 0.7, 0.7), ("gold", 1.0, 0.8, 0.0), ("beige", 0.9, 0.9, 0.7), ("navy", 0.0, 0.0, 0.5),
]

# ordered allow / deny rules for licence names: (substring, status)
LICENSE_RULES = [(x, "allowed") for x in ("mit license", "mit", "apache license 2.0", "apache 2.0", "apache software license", "bsd license", "bsd", "bsd-3-clause", "bsd-2-clause", "python software foundation license", "psf", "mozilla public license 2.0", "mpl-2.0")] + [(x, "restricted") for x in ("gpl", "lgpl", "agpl", "commercial", "proprietary")]
# ordered rules for the paths of data files: kind of rule, what it looks for, status
PATH_RULES = [
    *[("path", x, "allowed") for x in ("dataset/train.csv", "dataset/test.csv", "dataset/sample_test_out.csv")],
    *[("folder", x, "allowed") for x in ("dataset", "images", "cache", "embeddings", "models", "logs")],
    *[("anywhere", x, "prohibited") for x in ("external_data", "scraped_data", "api_data", "web_data", "crawled_data", "third_party_data")],
    *[("name", x, "suspicious") for x in ("external", "scraped", "crawled", "api_data", "web_data", "third_party", "additional_data", "extra_data")],
    *[("folder", x, "code") for x in ("src", "tests", "notebooks")],
]
# what in a program hints at data from elsewhere: substrings of the lower-cased text, patterns
CODE_WORDS = ["requests.get", "urllib.request", "wget", "curl", "api_key", "api_token", "scrape", "crawl", "external_url", "download_from", "fetch_data", "web_scraping"]
CODE_PATTERNS = ["pd.read_csv.*external", "pd.read_csv.*additional", "pd.read_csv.*extra", "load.*external.*data", "open.*external"]
EXPECTED_TRAIN = ["sample_id", "catalog_content", "image_link", "price"]
