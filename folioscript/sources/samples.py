"""Fixed values used when base tables are mapped onto the script data model."""

BOOK_STATUS = ["parsed", "analyzing", "cast", "generating", "ready", "error", "casting"]
STAGES = ["analyzing", "cast_review", "casting", "voice_review", "scripting_sample", "generating_sample", "sample_ready"]
MODELS = ["eleven_v3", "eleven_multilingual_v2", "eleven_flash_v2_5"]
JOB_TYPES = {
    "1-URGENT": "generate", "2-HIGH": "script", "3-MEDIUM": "analyze",
    "4-NOT SPECIFIED": "cast", "5-LOW": "intro",
}
ROMANS = ["I", "II", "IV", "IX", "XIV", "XL", "MIX", "V"]
ENDINGS = [".", ",", "?”", "—", "", "!)", ";\"", "…'"]
DELIVERIES = ["whisper", "shout", "angry", "fearful", "sad", "excited", "tender",
              "sarcastic", "urgent", "weary", "amused", "solemn"]
VARIANT_LABELS = ["child", "teen", "adult", "elderly"]
GENDERS = ["male", "female", "nonbinary", "unknown"]
AGE_RANGES = ["child", "8 years old", "30s", "40s", "middle-aged", "60s", "elderly", "adult", "12", "Young adult", ""]
ACCENT_HINTS = ["Jamaican", "West Indian", "", "Irish", "RP", "southern US", "none", "Glaswegian", "U.S.", "Indian", "creole", "Kiwi"]
HERITAGES = ["", "Nigerian", "Welsh", "", "Mexican", "Slavic", "French", ""]
VOICE_GENDERS = ["male", "female", "neutral", None]
VOICE_AGES = ["young", "middle_aged", "old"]
VOICE_ACCENTS = ["jamaican", "irish", "scottish", "welsh", "australian", "british", "american", "indian", "french",
                 "german", "russian", "spanish", "italian", "nigerian", "", None, "neutral"]
USE_CASES = ["narrative_story", "characters", None]
