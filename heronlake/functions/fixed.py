"""Word lists, patterns and constants that results depend on."""

# Patterns of question types, in order of precedence.
DRUG_QUESTION = r"\b(?:drug|medication|medicine|dose|dosage|mg|tablet|capsule|pill|prescri|pharmac|antibiotic|aspirin|ibuprofen|metformin|insulin|interaction|side\s*effect|contraindic)\b"
DEFINITION_QUESTION = r"^(?:what\s+is|what\s+are|define|explain|describe|tell\s+me\s+about|meaning\s+of|definition\s+of)\b"
SYMPTOM_QUESTION = r"\b(?:symptom|sign|feel|pain|ache|discomfort|nausea|fever|cough|fatigue|dizzy|swelling|bleed|rash|itch)\b"
COMPARISON_QUESTION = r"\b(?:difference|vs\.?|versus|compare|better|worse|than|between)\b"

# Fixed values: (dense, sparse) weights by question type.
FUSION_WEIGHTS = {"drug": (0.45, 0.55), "definition": (0.80, 0.20), "symptom": (0.65, 0.35), "comparison": (0.80, 0.20), "default": (0.70, 0.30)}

# BM25 parameters and the constant of reciprocal rank fusion.
BM25_K1, BM25_B, BM25_EPSILON = 1.2, 0.5, 0.25
RRF_K = 60

# Content that is moved behind all other hits.
HARMFUL_CONTENT = (
    r"\bhow\s+to\s+(?:make|synthesize|produce|create)\s+\w+\s+(?:drug|poison|explosive)",
    r"\bself[- ]harm\b",
    r"\b(?:illegal|illicit)\s+drug\s+(?:synthesis|recipe|formula)",
)

# Redaction of log lines, in order.
LOG_REDACTION = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    (r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)\d{3}[-.\s]?\d{4}\b", "[REDACTED_PHONE]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    (r"\b\d{10,16}\b", "[REDACTED_ID]"),
)

# Phrases that steer a model and are taken out of questions.
INJECTIONS = (r"ignore\s+(previous|above|all)\s+instructions", r"disregard\s+(previous|above|all)", r"you\s+are\s+now\s+", r"system\s*:\s*")

# Abbreviations and what they stand for.
ABBREVIATIONS = {
    "bp": "blood pressure", "hr": "heart rate", "rr": "respiratory rate", "spo2": "oxygen saturation", "bmi": "body mass index", "temp": "temperature",
    "ct": "computed tomography", "mri": "magnetic resonance imaging", "us": "ultrasound", "xr": "x-ray", "pet": "positron emission tomography",
    "cbc": "complete blood count", "bmp": "basic metabolic panel", "cmp": "comprehensive metabolic panel", "lfts": "liver function tests", "tsh": "thyroid stimulating hormone",
    "hba1c": "glycated hemoglobin", "pt": "prothrombin time", "inr": "international normalized ratio", "ptt": "partial thromboplastin time",
    "ecg": "electrocardiogram", "ekg": "electrocardiogram", "mi": "myocardial infarction", "cvd": "cardiovascular disease", "chf": "congestive heart failure",
    "afib": "atrial fibrillation", "af": "atrial fibrillation", "cabg": "coronary artery bypass grafting", "pci": "percutaneous coronary intervention", "htn": "hypertension",
    "tia": "transient ischemic attack", "ms": "multiple sclerosis", "als": "amyotrophic lateral sclerosis", "cva": "cerebrovascular accident stroke",
    "gerd": "gastroesophageal reflux disease", "ibs": "irritable bowel syndrome", "ibd": "inflammatory bowel disease", "gi": "gastrointestinal",
    "ckd": "chronic kidney disease", "esrd": "end stage renal disease", "aki": "acute kidney injury", "uti": "urinary tract infection",
    "copd": "chronic obstructive pulmonary disease", "pe": "pulmonary embolism", "dvt": "deep vein thrombosis", "ards": "acute respiratory distress syndrome",
    "dm": "diabetes mellitus", "t2dm": "type 2 diabetes mellitus", "t1dm": "type 1 diabetes mellitus", "pcos": "polycystic ovary syndrome", "dka": "diabetic ketoacidosis",
    "prn": "as needed", "bid": "twice daily", "tid": "three times daily", "qid": "four times daily", "qd": "once daily", "npo": "nothing by mouth", "stat": "immediately",
    "nhl": "non hodgkin lymphoma", "cll": "chronic lymphocytic leukemia", "aml": "acute myeloid leukemia",
}

# Phrases and words of the same meaning, in order of use.
SYNONYMS = (
    ("heart attack", ("myocardial infarction", "MI", "cardiac event", "coronary event")), ("high blood pressure", ("hypertension", "elevated BP", "elevated blood pressure")), ("hypertension", ("high blood pressure", "elevated BP")),
    ("stroke", ("cerebrovascular accident", "CVA", "brain attack")), ("chest pain", ("angina", "thoracic pain", "angina pectoris")), ("diabetes", ("diabetes mellitus", "DM", "hyperglycemia", "blood sugar disorder")),
    ("type 2 diabetes", ("T2DM", "type II diabetes", "adult-onset diabetes", "non-insulin dependent")), ("type 1 diabetes", ("T1DM", "type I diabetes", "juvenile diabetes", "insulin dependent")), ("high cholesterol", ("hyperlipidemia", "hypercholesterolemia", "dyslipidemia")),
    ("asthma", ("bronchial asthma", "reactive airway disease")), ("pneumonia", ("lung infection", "pulmonary infection")), ("copd", ("chronic obstructive pulmonary disease", "emphysema", "chronic bronchitis")),
    ("shortness of breath", ("dyspnea", "breathlessness", "difficulty breathing")), ("headache", ("cephalgia", "head pain")), ("migraine", ("migraine headache", "severe headache")), ("seizure", ("epileptic seizure", "convulsion", "fit")),
    ("alzheimer", ("alzheimer's disease", "AD", "dementia")), ("stomach pain", ("abdominal pain", "gastralgia", "belly ache", "epigastric pain")), ("acid reflux", ("GERD", "gastroesophageal reflux", "heartburn")), ("ibs", ("irritable bowel syndrome", "spastic colon")),
    ("arthritis", ("joint inflammation", "joint pain", "osteoarthritis")), ("back pain", ("lumbar pain", "lumbago", "dorsalgia")), ("depression", ("major depressive disorder", "MDD", "clinical depression")), ("anxiety", ("anxiety disorder", "generalized anxiety", "GAD")),
    ("fever", ("pyrexia", "elevated temperature", "high temperature")), ("infection", ("infectious disease", "pathogenic infection")), ("cancer", ("malignancy", "neoplasm", "tumor", "carcinoma")), ("allergy", ("allergic reaction", "hypersensitivity", "allergic response")),
    ("pregnancy", ("gestation", "expecting", "prenatal")), ("kidney disease", ("renal disease", "nephropathy", "kidney failure")), ("liver disease", ("hepatic disease", "liver disorder", "hepatopathy")),
)

# Question openings and the words that replace them, in order.
REFORMULATIONS = (
    ("what is ", " definition and explanation"), ("how to ", " treatment and management"), ("what are the symptoms of ", " clinical presentation signs"),
    ("what causes ", " etiology pathophysiology"), ("how do you treat ", " management therapy options"), ("is it safe to ", " safety risks contraindications"),
    ("can i take ", " drug interactions compatibility"), ("how long does ", " duration prognosis timeline"), ("why does ", " mechanism pathophysiology cause"),
    ("what happens if ", " complications consequences effects"), ("how is ", " diagnosed detection screening"), ("when should i ", " indications medical attention criteria"),
)
# Words with which a part of a split question may begin.
QUESTION_WORDS = ("what", "how", "why", "when", "where", "which", "can", "is")

# Urgent words, negations before them, and questions that only ask for knowledge.
EMERGENCY_WORDS = ("suicide", "suicidal", "kill myself", "end my life", "heart attack", "can't breathe", "chest pain", "stroke symptoms", "severe bleeding", "unconscious", "overdose", "poisoning", "anaphylaxis", "severe allergic reaction", "choking")
EMERGENCY_NEGATIONS = ("not", "no", "don't", "dont", "doesn't", "never", "without", "deny", "denies", "denied")
EDUCATIONAL = r"\b(what\s+is|what\s+are|define|explain|tell\s+me\s+about|symptoms\s+of|causes\s+of|treatment\s+for)\b"
SENSITIVE_TOPICS = ("pregnancy", "pregnant", "abortion", "mental health", "depression", "anxiety", "psychiatric", "cancer", "tumor", "malignant", "hiv", "aids", "std", "sexually transmitted", "surgery", "surgical", "operation", "prescription", "controlled substance")

# Patterns of harm with their weights.
HARM = (
    (r"\bguaranteed?\s+(cure|treatment|solution)", "false_promise", 0.8),
    (r"(will\s+)?cure\s+(your|the)\s+\w+", "false_promise", 0.7),
    (r"100%\s+(effective|safe|guaranteed)", "false_promise", 0.8),
    (r"stop\s+taking\s+(your|any)?\s*medication", "dangerous_advice", 1.0),
    (r"don't\s+take\s+(your|any)?\s*medication", "dangerous_advice", 1.0),
    (r"throw\s+away\s+(your|the)?\s*prescription", "dangerous_advice", 1.0),
    (r"no\s+need\s+(to\s+)?see\s+a\s+(doctor|physician)", "discouraging_care", 0.9),
    (r"don't\s+(need|have)\s+to\s+see\s+a\s+doctor", "discouraging_care", 0.9),
    (r"instead\s+of\s+(seeing\s+a\s+doctor|medical\s+care)", "discouraging_care", 0.8),
    (r"home\s+remedy\s+(is\s+)?better\s+than", "unproven_alternative", 0.6),
    (r"natural\s+cure\s+for\s+cancer", "unproven_alternative", 0.9),
    (r"(essential\s+)?oils?\s+(can\s+)?cure", "unproven_alternative", 0.7),
    (r"take\s+\d{3,}\s*(mg|ml)", "dangerous_dosage", 0.8),
    (r"(children|infant|baby)\s+should\s+take", "pediatric_risk", 0.7),
)

# Phrases of a question after a cause, and what tells of one in a document.
CAUSE_QUESTIONS = ("what causes", "what cause", "caused by", "why does", "why do", "etiology", "reason for")
CAUSE_MARKERS = ("caused by", "cause", "causes", "etiology", "due to", "trigger", "triggers", "because", "pathophysiology", "mechanism")

# Abbreviations whose full stop ends no sentence of an answer that is marked up.
MARKED_ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "mg.", "ml.", "vs.", "i.e.", "e.g.", "etc.")

# How answers cite.
CITATIONS = (
    r"\(\s*[A-Z][a-z]+(?:\s+et\s+al\.?)?,?\s*\d{4}\s*\)",
    r"according\s+to\s+(?:a\s+)?(?:recent\s+)?(?:study|research|paper)",
    r"published\s+in\s+(?:the\s+)?[A-Z]",
    r"\b(?:doi|DOI)\s*:\s*10\.\d{4,}",
)
