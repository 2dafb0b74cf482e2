"""Fixed values.

Everything in this module is a value the results depend on (lookup tables, word
lists, thresholds, patterns, formats).  It holds no logic.
"""

# Video category ids and display titles.
CATEGORY_TITLES = {
    1: "Film & Animation",
    2: "Autos & Vehicles",
    10: "Music",
    15: "Pets & Animals",
    17: "Sports",
    19: "Travel & Events",
    20: "Gaming",
    22: "People & Blogs",
    23: "Comedy",
    24: "Entertainment",
    25: "News & Politics",
    26: "Howto & Style",
    27: "Education",
    28: "Science & Technology",
    29: "Nonprofits & Activism",
}
CATEGORY_ID_RANGE = (1, 44)

# Regions the CSV loader accepts, and the wider set the quality suite accepts.
LOADER_REGIONS = ["US", "GB", "CA", "DE", "FR", "IN", "JP", "KR", "MX", "RU"]
SUITE_REGIONS = LOADER_REGIONS + ["BR", "ES", "IT", "AU", "NL"]

# Group memberships used as model features.
ENTERTAINMENT_CATEGORIES = [1, 23, 24]
EDUCATIONAL_CATEGORIES = [27, 28]
LIFESTYLE_CATEGORIES = [2, 15, 26]
ENGLISH_REGIONS = ["US", "GB", "CA", "AU"]
EUROPEAN_REGIONS = ["DE", "FR", "IT", "NL", "ES"]
ASIAN_REGIONS = ["IN", "JP", "KR"]

# Bands: ascending edges and one more label than edges.
VIEW_BANDS = ([10_000, 100_000, 1_000_000], ["Low", "Medium", "High", "Viral"])
ENGAGEMENT_BANDS = ([0.01, 0.05], ["Low", "Medium", "High"])
SPEED_BANDS = ([24.0, 72.0, 168.0], ["Very Fast", "Fast", "Medium", "Slow"])
ERROR_BANDS = ([0.1, 0.2, 0.5], ["Excellent", "Good", "Fair", "Poor"])

# Text placeholders and patterns.
NO_DESCRIPTION = "No description available"
NO_TAGS = "[none]"
TAG_DELIMITERS = "[|,;]"
CLICKBAIT_TERMS = [
    "shock", "amazing", "incredible", "unbelievable", "you won't believe",
    "secret", "revealed",
]
EMOJI_RANGES = [
    ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF"),
]
DEFAULT_PUBLISH_DATE = "2000-01-01 00:00:00"
SEARCH_VIDEO_KIND = "youtube#video"

# Sentiment terms and theme keywords (substring containment, lower case).
POSITIVE_TERMS = [
    "love", "amazing", "wonderful", "fantastic", "great", "happy", "joy", "fun",
    "exciting",
]
NEGATIVE_TERMS = [
    "hate", "terrible", "awful", "horrible", "worst", "bad", "angry", "sad",
    "disappointed",
]
THEME_KEYWORDS = {
    "Educational": ["learn", "tutorial", "howto", "education", "study", "lesson", "school"],
    "Entertainment": ["fun", "game", "play", "music", "comedy", "laugh", "enjoy"],
    "Technology": ["tech", "software", "app", "digital", "computer", "internet"],
    "Lifestyle": ["life", "health", "fitness", "food", "cooking", "travel"],
    "News": ["news", "politics", "world", "current", "event", "update"],
    "Business": ["business", "money", "career", "work", "professional", "success"],
}

# Audience age groups: id -> (name, youngest, oldest, complexity).
AGE_GROUPS = {
    0: ("Kids (0-12)", 0, 12, "Simple"),
    1: ("Teens (13-17)", 13, 17, "Moderate"),
    2: ("Young Adults (18-24)", 18, 24, "Moderate"),
    3: ("Adults (25-34)", 25, 34, "Advanced"),
    4: ("Middle-Aged Adults (35-49)", 35, 49, "Advanced"),
    5: ("Older Adults (50-64)", 50, 64, "Moderate"),
    6: ("Seniors (65+)", 65, 80, "Simple"),
}
# What an unknown group name gets: (youngest, oldest, complexity).
AGE_GROUP_FALLBACK = (0, 80, "Moderate")

# Term patterns behind the age indicators (whole words, any case).
AGE_TITLE_TERMS = {
    "educational": r"learn|tutorial|education|school|abc|123|colors|shapes",
    "entertainment": r"fun|funny|comedy|game|play|music|dance|challenge",
    "adult": r"adult|mature|explicit|18\+|sexy|alcohol|drugs|violence",
}
AGE_TAG_TERMS = {
    "educational": r"education|learning|tutorial|kids|children|school|abc",
    "entertainment": r"gaming|music|comedy|fun|play|entertainment",
    "adult": r"adult|mature|explicit|18\+|nsfw",
}
AGE_CATEGORY_GROUPS = {
    "kids": [1, 15],
    "teen": [10, 20, 23, 24],
    "adult": [22, 25, 28],
    "educational": [26, 27],
}
# Score weight of each indicator towards each age group id.
AGE_WEIGHTS = {
    0: {"category_is_kids": 3, "title_has_educational_terms": 2, "tags_has_educational": 2,
        "publish_is_morning": 1, "short_duration": 1},
    1: {"category_is_teen": 3, "title_has_entertainment_terms": 2, "tags_has_entertainment": 2,
        "publish_is_afternoon": 1, "medium_duration": 1},
    2: {"category_is_teen": 2, "title_has_entertainment_terms": 1, "publish_is_evening": 1,
        "medium_duration": 1, "high_engagement": 1},
    3: {"category_is_adult": 3, "title_has_adult_terms": 2, "publish_is_evening": 1,
        "publish_is_night": 1, "long_duration": 1},
    4: {"category_is_adult": 2, "publish_is_evening": 1, "publish_is_weekend": 1,
        "long_duration": 1},
    5: {"category_is_adult": 1, "publish_is_weekend": 2, "long_duration": 1},
    6: {"category_is_educational": 2, "publish_is_morning": 2, "short_duration": 1},
}

# English stop words of three letters or more; shorter tokens are dropped anyway.
STOP_WORDS = """
the and you your yours yourself yourselves our ours ourselves myself him his
himself she her hers herself its itself they them their theirs themselves what
which who whom this that these those are was were been being have has had having
does did doing but because until while with about against between into through
during before after above below from down out off over under again further then
once here there when where why how all any both each few more most other some
such nor not only own same than too very can will just don should now ain aren
couldn didn doesn hadn hasn haven isn mightn mustn needn shan shouldn wasn weren
won wouldn for
""".split()

# Noun endings and what stands in their place, and nouns without a regular plural.
NOUN_ENDINGS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
                ("men", "man"), ("ies", "y")]
IRREGULAR_NOUNS = {
    "analyses": "analysis", "axes": "axis", "bases": "basis", "calves": "calf", "children": "child",
    "crises": "crisis", "criteria": "criterion", "dice": "die", "elves": "elf", "feet": "foot", "geese": "goose",
    "halves": "half", "hypotheses": "hypothesis", "indices": "index", "knives": "knife", "leaves": "leaf",
    "lice": "louse", "lives": "life", "loaves": "loaf", "matrices": "matrix", "men": "man", "mice": "mouse",
    "news": "news", "oxen": "ox", "people": "people", "phenomena": "phenomenon", "selves": "self",
    "series": "series", "sheaves": "sheaf", "shelves": "shelf", "species": "species", "teeth": "tooth",
    "theses": "thesis", "thieves": "thief", "vertices": "vertex", "wives": "wife", "wolves": "wolf",
    "women": "woman",
}

# Model input columns.
NUMERIC_FEATURES = [
    "publish_hour", "publish_day_of_week", "publish_month", "publish_year",
    "time_to_trending_hours", "title_length", "title_word_count",
    "description_length", "description_word_count", "tag_count",
    "avg_tag_length", "unique_tag_count", "total_text_length",
    "like_rate", "comment_rate", "like_to_comment_ratio",
    "log_views", "log_likes", "log_comments", "engagement_score",
    "channel_name_length", "channel_word_count",
]
CATEGORICAL_FEATURES = [
    "category_id", "region_code", "view_category", "engagement_category",
    "trending_speed", "region_category_combo",
]
AGE_FEATURES = [
    "title_word_count", "title_avg_word_length", "title_has_numbers",
    "title_has_educational_terms", "title_has_entertainment_terms", "title_has_adult_terms",
    "description_length", "description_word_count", "description_complexity",
    "tag_count", "tags_has_educational", "tags_has_entertainment", "tags_has_adult",
    "category_is_kids", "category_is_teen", "category_is_adult", "category_is_educational",
    "publish_is_morning", "publish_is_afternoon", "publish_is_evening", "publish_is_night",
    "publish_is_weekend", "high_engagement", "medium_engagement", "low_engagement",
    "short_duration", "medium_duration", "long_duration",
]
# Identifiers and targets a regressor must not see, and columns computed from
# its targets, which would leak them.
REGRESSION_EXCLUDED = [
    "video_id", "title", "description", "tags", "channel_title", "channel_id",
    "publish_date", "trending_date", "extracted_at", "category_name",
    "thumbnail_url", "nlp_predicted_category", "nlp_category_confidence",
    "ml_predicted_views", "ml_predicted_engagement_rate", "processed_at",
    "views", "engagement_rate",
]
TARGET_DERIVED = [
    "log_views", "like_rate", "comment_rate", "engagement_score",
    "engagement_by_title_length", "engagement_by_tag_count",
    "high_engagement", "medium_engagement", "low_engagement",
]

# Gates.
NLP_ACCURACY_GATE = 0.85
R2_GATE = 0.85
QUALITY_GATE = 90.0
MIN_TRAINING_ROWS = 100
