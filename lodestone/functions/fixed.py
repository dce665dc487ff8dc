"""Word lists and tables that results depend on. Nothing here is logic."""

# Fixed: Arabic marks that carry no identity, as code point ranges, and the stretching line.
MARK_RANGES = "ؐ-ًؚ-ٰٟۖ-ۭ"
TATWEEL = "ـ"

# Fixed: words that the cleaner drops.
STOPWORDS = ("في", "على", "من", "الى", "إلى", "عن", "مع", "هذا", "هذه", "ذلك", "تلك", "كان", "كانت", "وقد", "كما", "او", "أو", "أن", "إن", "ما", "لا", "لم", "لن", "ثم")

# Fixed: escalation cues.
HIGH = ("قصف", "غارة", "اشتباك", "هجوم", "صاروخ", "انفجار", "مقتل", "اجتياح")
MEDIUM = ("توتر", "تهديد", "حشد", "عقوبات", "تحذير", "تصعيد")
LOW = ("اجتماع", "محادثات", "وساطة", "اتفاق", "تصريح", "زيارة")

# Fixed: topics in order of precedence, with their words.
TOPICS = {
    "Military": ("جيش", "قصف", "صاروخ", "اشتباك", "هجوم", "معركة", "غارة", "قوات"),
    "Politics": ("حكومة", "رئيس", "انتخابات", "برلمان", "وزارة", "سياسة", "دبلوماسية", "اتفاق"),
    "Protests": ("احتجاج", "مظاهرة", "إضراب", "متظاهرين", "اعتصام", "مسيرة"),
    "Economy": ("اقتصاد", "نفط", "تضخم", "استثمار", "تجارة", "بنك", "سوق", "عملة"),
    "Humanitarian": ("لاجئين", "مساعدات", "نازحين", "إغاثة", "مجاعة", "كارثة", "مدنيين"),
    "Sports": ("مباراة", "الدوري", "بطولة", "منتخب", "لاعب", "كرة القدم", "ملعب", "المدرب", "تشكيلة", "الزمالك", "برشلونة", "ريال مدريد", "رونالدو", "ميسي"),
}

# Fixed: countries in order of precedence, with their words.
COUNTRIES = {
    "Syria": ("سوريا", "سورية", "دمشق", "حلب", "ادلب"),
    "Iraq": ("عراق", "بغداد", "الموصل", "اربيل"),
    "Yemen": ("يمن", "صنعاء", "عدن", "حوثي"),
    "Lebanon": ("لبنان", "بيروت", "حزب الله"),
    "Palestine": ("فلسطين", "الضفة الغربية", "رام الله", "القدس"),
    "Gaza": ("غزة", "رفح", "خان يونس"),
    "Israel": ("اسرائيل", "تل ابيب"),
    "Egypt": ("مصر", "القاهرة"),
    "Libya": ("ليبيا", "طرابلس", "بنغازي"),
    "Sudan": ("سودان", "الخرطوم", "دارفور"),
    "Jordan": ("اردن",),
    "Saudi Arabia": ("سعودية", "الرياض", "جدة", "مكة"),
    "Iran": ("ايران", "طهران"),
    "Turkey": ("تركيا", "انقرة", "اسطنبول"),
    "UAE": ("امارات", "دبي", "ابوظبي"),
    "Qatar": ("قطر", "الدوحة"),
    "Kuwait": ("كويت",),
    "Bahrain": ("بحرين",),
    "Oman": ("سلطنة عمان", "مسقط"),
    "Tunisia": ("تونس",),
    "Algeria": ("جزائر",),
    "Morocco": ("مغرب", "الرباط"),
    "Somalia": ("صومال", "مقديشو"),
    "Afghanistan": ("افغانستان", "كابول"),
    "Pakistan": ("باكستان", "اسلام اباد"),
    "United States": ("امريكا", "الولايات المتحدة", "واشنطن"),
    "Russia": ("روسيا", "موسكو"),
    "Ukraine": ("اوكرانيا", "كييف"),
    "China": ("صين", "بكين"),
    "France": ("فرنسا", "باريس"),
    "United Kingdom": ("بريطانيا", "لندن"),
    "Germany": ("المانيا", "برلين"),
}

# Fixed: letters that writers swap, for comparison keys; an empty value deletes.
FOLDS = {
    "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي", "ء": "",
    "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
}

# Fixed: Latin spellings of letters, and of names that have customary ones.
ROMAN = {
    "ا": ("a",), "ب": ("b",), "ت": ("t",), "ث": ("th", "s"), "ج": ("j", "g"), "ح": ("h",), "خ": ("kh",), "د": ("d",), "ذ": ("dh", "z"), "ر": ("r",),
    "ز": ("z",), "س": ("s",), "ش": ("sh",), "ص": ("s",), "ض": ("d", "dh"), "ط": ("t",), "ظ": ("z", "dh"), "ع": ("a", "'"), "غ": ("gh", "g"), "ف": ("f",),
    "ق": ("q", "k"), "ك": ("k",), "ل": ("l",), "م": ("m",), "ن": ("n",), "ه": ("h",), "و": ("w",), "ي": ("y",),
}
ROMAN_NAMES = {
    "محمد": ("mohammed", "muhammad", "mohamed", "mohammad"),
    "احمد": ("ahmed", "ahmad"),
    "علي": ("ali", "aly"),
    "حسين": ("hussein", "husayn", "hussain"),
    "حسن": ("hassan", "hasan"),
    "عبدالله": ("abdullah", "abdallah", "abdulla"),
    "ابراهيم": ("ibrahim", "ebrahim"),
    "يوسف": ("youssef", "yousef", "yusuf"),
    "خالد": ("khaled", "khalid"),
    "عمر": ("omar", "umar"),
}

# Fixed: words of Latin names that carry no identity.
NAME_NOISE = ("the", "of", "al", "el", "bin", "ibn", "van", "von", "de", "da")

# Fixed: the pair scorer's learned weights, in the order of its features.
PAIR_FEATURES = ("name_similarity", "key_overlap", "co_mention_overlap", "temporal_proximity", "same_source", "same_type")
PAIR_WEIGHTS = (-0.38727821588656636, 2.9146602039585465, 0.11385964278537736, 0.12000789415532688, -0.42710610034849605, 0.0004612013994622047)
PAIR_INTERCEPT = -0.5957435208883064
PAIR_THRESHOLD = 0.6

#: Fixed: words whose dot ends no sentence.
ABBREVIATIONS = ("dr", "fig", "inc", "jr", "ltd", "mr", "mrs", "ms", "no", "prof", "sr", "st", "vs", "etc", "e.g", "i.e")
