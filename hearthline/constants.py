"""Word lists, patterns, thresholds and field lists results depend on."""

from __future__ import annotations

# --- fixed values: field lists -------------------------------------------------------------

LISTING_FIELDS = [
    "url", "id", "source", "property_type", "price", "currency", "description", "address",
    "governorate", "delegation", "locality", "postal_code", "living_area", "land_area",
    "room_count", "bathroom_count", "construction_year", "floor", "has_garage", "has_garden",
    "has_pool", "has_balcony", "has_terrace", "heating", "air_conditioning", "furnished",
    "phone", "agency", "contact_name", "listing_date", "last_updated", "photos", "features",
    "condition", "transaction_type",
]

ENRICH_FIELDS_SHORT = [
    "heating", "air_conditioning", "address", "governorate", "delegation", "locality",
    "has_garage", "has_garden", "has_pool", "has_balcony", "has_terrace", "room_count",
    "bathroom_count", "quality_score", "land_area",
]

ENRICH_TEXT_FIELDS = ["property_type", "address", "governorate", "delegation", "locality"]
ENRICH_NUMERIC_FIELDS = [
    "living_area", "land_area", "room_count", "bathroom_count", "construction_year",
    "quality_score",
]
ENRICH_BINARY_FIELDS = [
    "heating", "air_conditioning", "has_garage", "has_garden", "has_pool", "has_balcony",
    "has_terrace", "has_elevator", "furnished", "has_security", "modern_kitchen", "sea_view",
    "city_center", "needs_renovation", "excellent_condition", "new_construction",
]

SERVING_FEATURES = [
    "living_area", "land_area", "room_count", "bathroom_count", "price_per_sqm", "total_area",
    "living_to_land_ratio", "avg_room_size", "bathroom_room_ratio", "description_length",
    "description_word_count", "avg_word_length", "punctuation_density", "luxury_score",
    "ai_property_score", "investment_potential", "has_garage", "has_garden", "has_pool",
    "has_balcony", "has_terrace", "has_elevator", "has_security", "is_appartement", "is_maison",
    "is_villa", "is_terrain", "is_apartment", "is_house", "is_local_commercial", "is_duplex",
    "is_studio", "is_bureau", "is_major_city", "is_coastal", "gov_tunis", "gov_cap_bon",
    "gov_nabeul", "gov_unknown", "gov_bizerte", "gov_medenine", "gov_ariana", "gov_ben_arous",
    "has_swimming_pool", "has_modern", "has_luxury", "has_sea_view", "has_furnished",
    "is_excellent_condition", "is_good_condition", "is_needs_renovation", "is_new_construction",
    "property_tier_Basic", "property_tier_Economy", "property_tier_Premium",
    "property_tier_Standard", "market_segment_Budget", "market_segment_Entry-Level",
    "market_segment_Luxury", "market_segment_Mid-Market", "market_segment_Upper-Mid",
]

# --- fixed values: null tokens, categories -------------------------------------------------

NULL_TOKENS = ["nan", "null", "none", "n/a", "na"]

UNWANTED_PROPERTY_TYPES = [
    "Terrain", "Local commercial", "Bureau", "Surfaces", "Autre", "Terrain nu",
    "Place de parc", "Terrain agricole", "Commerces", "Terrains", "Lots", "Bureaux",
    "Locaux commerciaux", "Terrain agr", "Fond de Com", "Gérance lib", "Atelier",
]

GOVERNORATE_RULES = {
    "tunis": "Tunis", "ariana": "Ariana", "ben arous": "Ben Arous", "manouba": "Manouba",
    "nabeul": "Nabeul", "zaghouan": "Zaghouan", "bizerte": "Bizerte", "beja": "Beja",
    "jendouba": "Jendouba", "kef": "Le Kef", "siliana": "Siliana", "sousse": "Sousse",
    "monastir": "Monastir", "mahdia": "Mahdia", "sfax": "Sfax", "kairouan": "Kairouan",
    "kasserine": "Kasserine", "sidi bouzid": "Sidi Bouzid", "gabes": "Gabes",
    "medenine": "Medenine", "tataouine": "Tataouine", "gafsa": "Gafsa", "tozeur": "Tozeur",
    "kebili": "Kebili",
}

MAJOR_CITIES_BATCH = ["Tunis", "Sfax", "Sousse", "Ariana", "Ben Arous"]
MAJOR_CITIES_SERVE = ["tunis", "sfax", "sousse", "kairouan", "bizerte"]
COASTAL_BATCH = [
    "Tunis", "Ariana", "Ben Arous", "Nabeul", "Bizerte", "Sousse", "Monastir", "Mahdia",
    "Sfax", "Gabes", "Medenine",
]
COASTAL_SERVE = ["tunis", "nabeul", "sousse", "monastir", "mahdia", "sfax", "bizerte"]

SERVE_GOVERNORATE_FLAGS = {
    "gov_tunis": ["tunis"],
    "gov_cap_bon": ["cap bon", "nabeul"],
    "gov_nabeul": ["nabeul"],
    "gov_bizerte": ["bizerte"],
    "gov_medenine": ["medenine", "médenine"],
    "gov_ariana": ["ariana"],
    "gov_ben_arous": ["ben arous"],
}

SERVE_TYPE_FLAGS = {
    "is_appartement": "appartement", "is_maison": "maison", "is_villa": "villa",
    "is_terrain": "terrain", "is_apartment": "apartment", "is_house": "house",
    "is_local_commercial": "commercial", "is_duplex": "duplex", "is_studio": "studio",
    "is_bureau": "bureau",
}

# --- fixed values: text keywords -----------------------------------------------------------

AMENITY_KEYWORDS = {
    "swimming_pool": ["piscine", "pool", "swimming"],
    "garden": ["jardin", "garden", "espaces verts"],
    "garage": ["garage", "parking couvert"],
    "terrace": ["terrasse", "terrace", "balcon"],
    "modern": ["moderne", "modern", "contemporain", "neuf"],
    "luxury": ["luxe", "luxury", "haut standing", "standing"],
    "sea_view": ["vue mer", "sea view", "front de mer"],
    "furnished": ["meublé", "furnished", "équipé"],
    "elevator": ["ascenseur", "elevator", "lift"],
    "security": ["sécurité", "security", "gardiennage", "concierge"],
}

CONDITION_KEYWORDS = {
    "excellent_condition": ["excellent état", "parfait état", "excellent condition"],
    "good_condition": ["bon état", "good condition", "bien entretenu"],
    "needs_renovation": ["à rénover", "renovation needed", "travaux"],
    "new_construction": ["nouvelle construction", "new construction", "récemment construit"],
}

LUXURY_WORDS = [
    "luxury", "luxe", "luxueux", "prestige", "prestigieux", "haut de gamme", "standing",
    "vue mer", "piscine", "jardin", "garage", "moderne", "neuf", "rénové", "climatisé",
    "meublé", "terrasse", "balcon",
]
POSITIVE_WORDS = [
    "excellent", "parfait", "magnifique", "spacieux", "lumineux", "calme", "sécurisé",
    "proche", "accessible", "idéal",
]
INVESTMENT_WORDS = [
    "centre ville", "proche metro", "transport", "école", "université", "commercial",
    "business", "investissement", "rentable",
]

# name -> (stored boolean column or None, keywords)
SERVE_AMENITY_FLAGS = {
    "has_garage": ("has_garage", ["garage"]),
    "has_garden": ("has_garden", ["jardin"]),
    "has_pool": ("has_pool", ["piscine"]),
    "has_balcony": ("has_balcony", ["balcon"]),
    "has_terrace": ("has_terrace", ["terrasse"]),
    "has_elevator": (None, ["ascenseur", "elevator"]),
    "has_security": (None, ["sécurité", "gardien"]),
    "has_swimming_pool": ("has_pool", ["piscine"]),
    "has_modern": (None, ["moderne"]),
    "has_luxury": (None, ["luxe", "luxury", "prestige"]),
    "has_sea_view": (None, ["vue mer"]),
    "has_furnished": ("furnished", ["meublé"]),
}
SERVE_CONDITION_FLAGS = {
    "is_excellent_condition": ["excellent", "parfait", "impeccable"],
    "is_good_condition": ["bon état", "good", "bien"],
    "is_needs_renovation": ["rénover", "renovation", "travaux"],
    "is_new_construction": ["neuf", "nouveau", "construction"],
}

# Broken UTF-8 sequences after lower-casing, longest first so the short one cannot hide them.
MOJIBAKE_FIXES = [
    ("â\x80\x93", "-"), ("â\x80\x99", "'"), ("â\x80\x9c", '"'), ("â\x80\x9d", '"'),
    ("ã©", "é"), ("ã¨", "è"), ("ã¡", "à"), ("ã¢", "â"), ("ã§", "ç"), ("ã´", "ô"),
]

# --- fixed values: patterns ----------------------------------------------------------------

PHONE_PATTERN = r"(?:\+?216[-.\s]?)?(\d{2}[-.\s]?\d{3}[-.\s]?\d{3,4}|\d{8})"
PROPERTY_TYPE_PATTERNS = {
    "Maison": r"\b(maison|villa|pavillon)\b",
    "Appartement": r"\bappartement\b",
    "Terrain": r"\bterrain\b",
    "Duplex": r"\bduplex\b",
    "Studio": r"\bstudio\b",
}
# layout -> ordered (value, pattern); first match wins
TRANSACTION_PATTERNS = {
    "options": [("sale", r"\b(?:a|à)\s*vendre\b"), ("rent", r"\b(?:a|à)\s*louer\b")],
    "boxes": [
        ("rent", r"\bfor\s*rent\b|\bà\s*louer\b|\ba\s*louer\b"),
        ("sale", r"\bfor\s*sale\b|\bà\s*vendre\b|\ba\s*vendre\b|\bvendu?\b"),
    ],
}
OPTION_LABELS = {
    "has_garage": ["Garage"], "has_garden": ["Jardin"], "has_pool": ["Piscine"],
    "has_balcony": ["Balcon"], "has_terrace": ["Terrasse", "Terrasses"],
    "heating": ["Chauffage", "Chauffage électriques"],
    "air_conditioning": ["Climatisation", "Climatise"], "furnished": ["Meublé", "Meuble"],
}
BOX_LABELS = {
    "has_garden": ["Garden"], "has_terrace": ["Terrace"], "has_garage": ["Garage"],
    "has_pool": ["Pool", "Piscine"], "air_conditioning": ["Air conditioning"],
    "heating": ["Heating"],
}
BOX_TEXT_PATTERNS = {
    "has_garden": "garden", "has_terrace": "terrace", "has_pool": r"\bpool|piscine\b",
    "has_balcony": r"\bbalcony|balcon\b", "furnished": r"\bfurnished|meublé|meuble\b",
}
DESCRIPTION_STEMS = {
    "has_balcony": "balcon", "has_terrace": "terrass", "has_garden": "jardin",
    "has_pool": "piscine", "has_garage": "garage",
}
OPTION_DETAIL_LABELS = {
    "room_count": "Chambres :", "bathroom_count": "Salle de bain :",
    "living_area": "Surf habitable :", "land_area": "Surf terrain :",
}

# --- fixed values: domains of the manual form ----------------------------------------------

FORM_DOMAINS = {
    "property_type": ["Maison", "Appartement", "Villa", "Duplex", "Studio", "Terrain", "Bureau",
                      "Local Commercial"],
    "transaction_type": ["Vente", "Location", "Location saisonnière"],
    "currency": ["DT", "EUR", "USD"],
    "governorate": ["Tunis", "Ariana", "Ben Arous", "Manouba", "Nabeul", "Zaghouan", "Bizerte",
                    "Béja", "Jendouba", "Kef", "Siliana", "Sousse", "Monastir", "Mahdia", "Sfax",
                    "Kairouan", "Kasserine", "Sidi Bouzid", "Gabès", "Medenine", "Tataouine",
                    "Gafsa", "Tozeur", "Kebili"],
    "condition": ["Excellent", "Very Good", "Good", "Fair", "Needs Renovation"],
}

# --- fixed values: thresholds --------------------------------------------------------------

PRICE_RANGE = (10_000.0, 50_000_000.0)
DOCUMENTED_PRICE_RANGE = (10_000.0, 10_000_000.0)
DOCUMENTED_AREA_RANGE = (10.0, 2_000.0)
TRAINING_PRICE_FLOOR = 1_000.0

SEGMENT_CUTS = {
    "batch": [(100_000, "Budget"), (200_000, "Entry-Level"), (400_000, "Mid-Market"),
              (800_000, "Upper-Mid"), (None, "Luxury")],
    "serve": [(200_000, "Budget"), (400_000, "Entry-Level"), (800_000, "Mid-Market"),
              (1_500_000, "Upper-Mid"), (None, "Luxury")],
}
SERVE_TIER_CUTS = [(80, "Basic"), (120, "Standard"), (200, "Premium"), (None, "Economy")]
TIERS = ["Basic", "Economy", "Premium", "Standard"]
SEGMENTS = ["Budget", "Entry-Level", "Luxury", "Mid-Market", "Upper-Mid"]

PRICE_BANDS = {
    "small": [(0, 50_000, "Low ($0-50K)"), (50_000, 100_000, "Medium ($50K-100K)"),
              (100_000, 200_000, "High ($100K-200K)"), (200_000, None, "Very High ($200K+)")],
    "documented": [(0, 200_000, "0-200K"), (200_000, 500_000, "200K-500K"),
                   (500_000, 1_000_000, "500K-1M"), (1_000_000, None, "1M+")],
}
MAPE_GRADES = [(10.0, "Excellent"), (20.0, "Good"), (30.0, "Moderate"), (None, "Poor")]
R2_GRADES = [(0.8, "Strong"), (0.6, "Good"), (0.4, "Moderate"), (None, "Weak")]
