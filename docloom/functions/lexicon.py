"""Vocabularies and rules of technical documents, as data. Every operator takes its own as parameters; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists, patterns, weights and formats that results depend on.

ACRONYMS = {
    "SPS": "Speicherprogrammierbare Steuerung",
    "HMI": "Human Machine Interface",
    "SCADA": "Supervisory Control And Data Acquisition",
    "PLC": "Programmable Logic Controller",
    "VFD": "Variable Frequency Drive",
    "I/O": "Input Output",
    "AI": "Analog Input",
    "DI": "Digital Input",
    "CPU": "Central Processing Unit",
    "RAM": "Random Access Memory",
    "ROM": "Read Only Memory",
}
UNITS = [("mm", "millimeter"), ("cm", "zentimeter"), ("m", "meter"), ("kg", "kilogramm"), ("g", "gramm"), ("bar", "bar druck"), ("°c", "grad celsius")]
STEM_SUFFIXES = ["ung", "heit", "keit", "lich", "isch", "bar", "los", "voll", "er", "en", "es", "e", "s"]
INDUSTRIAL_REWRITES = [
    (r"\bspeicher\w*steuer\w*", "sps"),
    (r"\bhuman\s*machine\s*interface\b", "hmi"),
    (r"\bprogrammable\s*logic\s*controller\b", "plc"),
    (r"\bvariable\s*frequency\s*drive\b", "frequenzumrichter"),
]
GLOSSES = {"motor": "motor engine", "pumpe": "pump", "ventil": "valve", "sensor": "sensor detector", "steuerung": "control controller", "fehler": "error fault"}
SYNONYMS = {
    "fehler": ["störung", "defekt", "problem", "alarm"],
    "motor": ["antrieb", "maschine", "aggregat"],
    "pumpe": ["verdichter", "gebläse", "kompressor"],
    "ventil": ["absperrorgan", "regelventil", "stellglied"],
    "sensor": ["messfühler", "detektor", "aufnehmer"],
    "temperatur": ["wärme", "hitze", "grad"],
    "druck": ["kraft", "belastung", "spannung"],
    "sicherheit": ["safety", "schutz", "protection"],
    "wartung": ["maintenance", "instandhaltung", "service"],
}
TECHNICAL_TERMS = [
    "sps", "plc", "hmi", "scada", "profibus", "profinet", "modbus", "motor", "antrieb", "servo", "frequenzumrichter", "encoder", "sensor", "aktor", "ventil",
    "pumpe", "kompressor", "temperatur", "druck", "durchfluss", "füllstand", "pneumatik", "hydraulik", "safety", "sicherheit", "notaus", "wartung", "maintenance", "diagnose", "kalibrierung",
]
QUERY_ABBREVIATIONS = {
    "sps": "speicherprogrammierbare steuerung",
    "hmi": "human machine interface",
    "scada": "supervisory control and data acquisition",
    "plc": "programmable logic controller",
    "vfd": "variable frequency drive",
    "io": "input output",
    "ai": "analog input",
    "di": "digital input",
}
QUERY_SYNONYMS = {
    "fehler": ["störung", "defekt", "problem", "alarm"],
    "motor": ["antrieb", "maschine", "aggregat"],
    "sensor": ["messfühler", "detektor", "aufnehmer"],
    "ventil": ["absperrorgan", "regelventil", "stellglied"],
    "pumpe": ["verdichter", "gebläse", "kompressor"],
    "temperatur": ["wärme", "hitze", "grad"],
    "druck": ["kraft", "belastung", "spannung"],
    "sicherheit": ["safety", "protection", "schutz"],
}
DOMAIN_SUFFIXES = ["wartung", "konfiguration"]
TRANSLATIONS = {
    "motor": "engine drive",
    "pumpe": "pump",
    "ventil": "valve",
    "sensor": "sensor detector",
    "steuerung": "control controller",
    "sicherheit": "safety protection",
    "fehler": "error fault alarm",
    "wartung": "maintenance service",
}
SEMANTIC_TERMS = [
    "sps", "plc", "steuerung", "programmierung", "ladder", "fbd", "st", "il", "profibus", "profinet", "modbus", "ethernet", "fieldbus", "canbus",
    "hmi", "scada", "bedienoberfläche", "visualisierung", "alarmierung", "trending", "logging", "archivierung", "reporting",
    "motor", "antrieb", "servo", "frequenzumrichter", "vfd", "encoder", "resolver", "getriebe", "kupplung", "bremse", "lageregelung",
    "sensor", "aktor", "messfühler", "transmitter", "converter", "temperatur", "druck", "durchfluss", "füllstand", "position", "näherung", "lichtschranke", "ultraschall", "radar", "lidar",
    "pneumatik", "hydraulik", "zylinder", "ventil", "kompressor", "filter", "regler", "manometer", "flowmeter",
    "safety", "sicherheit", "notaus", "schutztür", "lichtgitter", "kategorie", "sil", "pfd", "mttf", "diagnostic", "failsafe",
    "wartung", "instandhaltung", "maintenance", "diagnose", "troubleshooting", "kalibrierung", "justierung", "verschleiß", "lebensdauer",
]
SAFETY_KEYWORDS = [
    "safety", "sicherheit", "notaus", "emergency", "stop", "schutz", "kategorie", "category", "sil", "pfd", "mttf", "failsafe", "fail-safe", "redundant", "diverse", "diagnostic", "test", "proof",
    "gefahr", "danger", "hazard", "risk", "risiko", "norm", "standard", "ce", "iec", "iso", "din", "en", "ansi", "osha", "atex", "explosion",
]
ADAPTIVE_TERMS = [
    "sps", "plc", "hmi", "scada", "profibus", "profinet", "modbus", "siemens", "allen", "bradley", "schneider", "omron", "mitsubishi", "motor", "antrieb", "servo", "frequenz", "umrichter", "encoder",
    "sensor", "aktor", "ventil", "pneumatik", "hydraulik", "temperatur", "druck", "durchfluss", "level", "position", "sicherheit", "safety", "kategorie", "sil", "pfd", "mttf",
    "wartung", "maintenance", "diagnose", "fehler", "alarm", "störung",
]
CONCEPT_WORDS = [
    "warum", "wieso", "weshalb", "wie", "was", "wann", "wo", "why", "how", "what", "when", "where", "funktioniert", "arbeitet", "unterschied", "vergleich", "prinzip", "konzept", "theorie", "grundlagen",
]
QUERY_TYPES = {
    "factual": [r"\b(?:was ist|was sind|definiere|erkläre|bedeutung)\b", r"\b(?:wie viel|wie viele|wann|wo|wer)\b"],
    "procedural": [r"\b(?:wie|schritt|anleitung|prozess|verfahren)\b", r"\b(?:reihenfolge|nacheinander|zuerst|dann|anschließend)\b"],
    "troubleshooting": [r"\b(?:problem|fehler|störung|defekt|funktioniert nicht)\b", r"\b(?:troubleshooting|diagnose|beheben|reparieren|lösung)\b"],
    "specification": [r"\b(?:spezifikation|technische daten|parameter|eigenschaften)\b", r"\b(?:norm|standard|anforderung|richtlinie)\b"],
    "comparative": [r"\b(?:vergleich|unterschied|besser|schlechter|vs)\b", r"\b(?:alternative|option|auswahl|empfehlung)\b"],
}
QUERY_TERMS = [
    "motor", "sensor", "aktor", "steuerung", "regelung", "plc", "scada", "pneumatik", "hydraulik", "antrieb", "frequenzumrichter", "servo", "encoder", "resolver", "bus", "protokoll", "ethernet", "profinet",
]
QUERY_DOMAINS = ["industrie", "automation", "fertigung", "produktion", "anlage", "maschine", "roboter", "förderband", "handling", "montage"]
SEQUENTIAL_WORDS = ["schritt", "reihenfolge", "nacheinander", "zuerst", "dann", "anschließend"]

STEP_PATTERNS = [r"\d+\.\s+\w+", r"\d+\)\s+\w+", r"Schritt\s+\d+", r"Step\s+\d+"]
KEYWORD_PATTERNS = [r"\b[A-Z]{2,}\b", r"\b\w+(?:spannung|leistung|strom)\b", r"\b(?:demo|start|installation|setup)\b", r"\d+(?:\.\d+)?\s*(?:V|A|W|Hz|MHz|GHz)\b", r"\b(?:IP|TCP|UDP|HTTP|FTP)\b"]
TERM_PATTERNS = [
    r"\b(?:API|REST|JSON|XML|SQL|HTTP|HTTPS|FTP|SSH)\b",
    r"\b(?:CPU|GPU|RAM|SSD|HDD|USB|HDMI|VGA)\b",
    r"\b(?:Windows|Linux|macOS|Android|iOS)\b",
    r"\b\d+(?:\.\d+)?\s*(?:GB|MB|TB|GHz|MHz|V|A|W)\b",
]
GERMAN_WORDS = ["der", "die", "das", "und", "oder", "mit", "von", "zu", "für", "ist", "sind", "wird", "werden", "haben", "sein", "auf", "in"]
ENGLISH_WORDS = ["the", "and", "or", "with", "from", "to", "for", "of", "in", "is", "are", "will", "have", "be", "on", "at", "by"]


@dataclass(frozen=True)
class Analyzer:
    """Word lists of the content-type cascade."""

    demo: tuple[str, ...] = ("demo", "start", "starten", "anleitung", "begin", "beginnen", "launch", "öffnen", "aktivieren", "initialisieren")
    step: tuple[str, ...] = ("schritt", "klicken", "öffnen", "drücken", "wählen", "auswählen", "step", "click", "open", "press", "select", "choose")
    install: tuple[str, ...] = ("installation", "setup", "install", "configure")
    technical: tuple[str, ...] = ("spannung", "leistung", "technische daten", "voltage", "power", "specifications")
    trouble: tuple[str, ...] = ("fehler", "problem", "troubleshooting", "error", "issue", "fix")


INDUSTRIAL_ANALYZER = Analyzer(
    technical=Analyzer.technical + ("maschine", "anlage", "steuerung", "sensor", "aktor", "sps", "hmi", "scada", "feldbus", "profibus", "profinet"),
    trouble=Analyzer.trouble + ("störung", "ausfall", "wartung", "instandhaltung", "reparatur", "diagnose", "maintenance", "repair", "malfunction"),
)
SOFTWARE_ANALYZER = Analyzer(
    technical=Analyzer.technical + ("api", "database", "frontend", "backend", "framework", "library", "package", "module", "class", "function"),
    install=Analyzer.install + ("npm install", "pip install", "composer install", "deployment", "build", "compile", "docker", "kubernetes"),
)


@dataclass(frozen=True)
class Rule:
    """A classification rule: any keyword substring or any pattern (all keywords if requires_all) adds weight to its category."""

    name: str
    category: str
    keywords: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    weight: float = 1.0
    requires_all: bool = False


BASE_RULES = [
    Rule("safety_warnings", "safety", ("warnung", "warning", "achtung", "caution", "gefahr", "danger", "vorsicht", "hinweis", "notice", "sicherheit", "safety"), (r"\b(?:WARNUNG|WARNING|ACHTUNG|CAUTION|GEFAHR|DANGER)\b", r"⚠️|⚡|☢️|☣️", r"\brisiko\b|\brisk\b", r"\bverletzung\b|\binjury\b"), ("has_warnings", "requires_expertise"), 0.9),
    Rule("technical_specifications", "specifications", ("technische daten", "technical data", "spezifikation", "specification", "parameter", "eigenschaften", "properties", "kennwerte", "ratings"), (r"\b\d+(?:\.\d+)?\s*(?:V|A|W|Hz|MHz|GHz|°C|bar|psi|rpm)\b", r"\b(?:spannung|voltage|strom|current|leistung|power)\s*[:=]\s*\d+", r"\b(?:min|max|typ)\.\s*\d+", r"\btabelle\s+\d+|\btable\s+\d+"), ("has_specifications", "has_tables"), 0.8),
    Rule("installation_procedures", "installation", ("installation", "montage", "aufbau", "setup", "konfiguration", "configuration", "anschluss", "connection", "verdrahtung", "wiring"), (r"\b(?:schritt|step)\s+\d+", r"\b\d+\.\s+(?:installieren|install|montieren|mount)", r"\banschlussplan|\bwiring\s+diagram", r"\bpin\s+\d+|\bklemme\s+\d+"), ("has_procedures", "has_diagrams"), 0.7),
    Rule("operation_procedures", "operation", ("bedienung", "operation", "betrieb", "anwendung", "usage", "steuerung", "control", "start", "stop", "betätigen", "activate"), (r"\bdrücken\s+sie|\bpress\s+the", r"\bklicken\s+auf|\bclick\s+on", r"\bmenü\s+→|\bmenu\s+→", r"\bhmi\b|\bscada\b|\bsps\b"), ("has_procedures",), 0.6),
    Rule("maintenance_procedures", "maintenance", ("wartung", "maintenance", "instandhaltung", "service", "inspektion", "inspection", "reinigung", "cleaning", "schmierung", "lubrication", "austausch", "replacement", "reparatur", "repair"), (r"\b(?:alle|every)\s+\d+\s+(?:stunden|hours|tage|days|monate|months)", r"\bwartungsintervall|\bmaintenance\s+interval", r"\bverschleißteil|\bwear\s+part", r"\bölwechsel|\boil\s+change"), ("has_procedures", "requires_expertise"), 0.7),
    Rule("troubleshooting_procedures", "troubleshooting", ("troubleshooting", "fehlerbehebung", "störung", "problem", "fehler", "error", "alarm", "diagnose", "diagnosis", "lösung", "solution", "behebung", "fix"), (r"\bfehlermeldung|\berror\s+message|\balarm\s+\d+", r"\bprüfen\s+sie|\bcheck\s+the", r"\bursache|\bcause|\bgrund|\breason", r"\b(?:led|status)\s+(?:rot|red|grün|green|gelb|yellow)"), ("has_procedures", "requires_expertise"), 0.8),
    Rule("compliance_standards", "compliance", ("norm", "standard", "richtlinie", "directive", "zertifikat", "certificate", "konformität", "compliance", "ce-kennzeichnung", "ce marking", "atex", "iec", "iso", "din"), (r"\b(?:EN|IEC|ISO|DIN|ANSI|IEEE)\s+\d+", r"\bce\s*[-\s]*mark", r"\batex\s+zone|\bexplosion\s+protection", r"\bzertifikat\s+nr\.|\bcertificate\s+no\."), (), 0.6),
    Rule("has_diagrams", "documentation", (), (r"\b(?:abbildung|figure|abb\.|fig\.)\s+\d+", r"\b(?:diagramm|diagram|schema|schematic)", r"\b(?:siehe|see)\s+(?:bild|image|foto|photo)"), ("has_diagrams",), 0.3),
    Rule("has_calculations", "specifications", (), (r"[=×÷+\-]\s*\d+(?:\.\d+)?", r"\b(?:formel|formula|berechnung|calculation)", r"\b[A-Z]\s*=\s*\d+", r"√|∑|∫|π"), ("has_calculations", "requires_expertise"), 0.4),
]
INDUSTRIAL_RULES = BASE_RULES + [
    Rule("machine_controls", "operation", ("sps", "plc", "hmi", "scada", "steuerung", "control"), (r"\bI/O\s+module", r"\bfieldbus\b", r"\bprofibus\b", r"\bprofinet\b"), (), 0.8),
    Rule("electrical_safety", "safety", ("hochspannung", "high voltage", "lebensgefahr", "electrical hazard"), (r"\b\d+\s*kV\b", r"\b(?:not|nicht)\s+(?:hot|spannungsführend)"), ("has_warnings", "requires_expertise"), 0.95),
]
SOFTWARE_RULES = BASE_RULES + [
    Rule("api_documentation", "specifications", ("api", "endpoint", "rest", "json", "xml", "parameter"), (r"\b(?:GET|POST|PUT|DELETE)\s+/", r"\b\{.*\}", r"\bHTTP\s+\d{3}"), (), 0.8),
]
CATEGORY_OF_TYPE = {"step_by_step_guide": "installation", "demo_instructions": "operation", "installation_guide": "installation", "technical_specifications": "specifications", "troubleshooting": "troubleshooting", "general": "documentation"}

DOMAINS = {
    "electrical": (("spannung", "voltage", "strom", "current", "leistung", "power", "widerstand", "resistance", "kondensator", "capacitor"), (r"\b\d+\s*(?:V|A|W|Ω|F|H)\b", r"\b(?:AC|DC)\b", r"\bkV\b")),
    "mechanical": (("drehmoment", "torque", "drehzahl", "rpm", "lager", "bearing", "kupplung", "coupling", "getriebe", "gearbox"), (r"\b\d+\s*(?:rpm|min⁻¹|Nm|bar)\b", r"\bM\d+\s*(?:schrauben|bolts)")),
    "hydraulic": (("hydraulik", "hydraulic", "druck", "pressure", "pumpe", "pump", "ventil", "valve", "zylinder", "cylinder"), (r"\b\d+\s*(?:bar|psi|l/min|gpm)\b", r"\bhydraulik(?:öl|oil)")),
    "pneumatic": (("pneumatik", "pneumatic", "druckluft", "compressed air", "kompressor", "compressor"), (r"\b\d+\s*bar\s*(?:luft|air)", r"\bdruckluft")),
    "automation": (("sps", "plc", "hmi", "scada", "sensor", "aktor", "actuator", "steuerung", "control", "regelung", "regulation"), (r"\b(?:I/O|E/A)\b", r"\bfieldbus\b", r"\bprofibus\b", r"\bprofinet\b")),
    "safety": (("sicherheit", "safety", "schutz", "protection", "not-aus", "emergency stop", "lichtvorhang", "light curtain"), (r"\bSIL\s*[0-4]", r"\b(?:CE|ATEX)\b", r"\bkategorie\s*[1-4]")),
}
INDUSTRIAL_DOMAINS = DOMAINS | {
    "process_control": (("prozess", "process", "regelung", "control", "pid", "setpoint"), (r"\bPID\b", r"\bsetpoint\b", r"\bcontroller\b")),
    "quality_assurance": (("qualität", "quality", "prüfung", "inspection", "test", "messung"), (r"\bQS\b", r"\bISO\s+\d+", r"\bmessprotokoll\b")),
}
CRITICAL_PATTERNS = [r"\b(?:lebensgefahr|danger|hochspannung|high\s+voltage)\b", r"\b\d+\s*kV\b", r"⚠️|⚡|☢️|☣️"]
HIGH_SAFETY = ["warnung", "warning", "achtung", "caution", "vorsicht"]
LOW_SAFETY = ["sicherheit", "safety", "schutz", "protection"]
EXPERT_PATTERNS = [r"\b(?:kalibrierung|calibration|justierung|adjustment)\b", r"\bservice\s*(?:modus|mode)\b", r"\b(?:reparatur|repair|instandsetzung)\b"]
BASIC_TERMS = ["parameter", "einstellung", "konfiguration", "setting"]
SECTIONS = {
    "introduction": r"\b(?:einleitung|introduction|übersicht|overview)\b",
    "installation": r"\b(?:installation|montage|aufbau|setup)\b",
    "operation": r"\b(?:bedienung|operation|betrieb|anwendung)\b",
    "maintenance": r"\b(?:wartung|maintenance|instandhaltung|service)\b",
    "troubleshooting": r"\b(?:troubleshooting|fehlerbehebung|störung|problem)\b",
    "specifications": r"\b(?:technische\s+daten|technical\s+data|spezifikation)\b",
    "safety": r"\b(?:sicherheit|safety|sicherheitshinweise|safety\s+instructions)\b",
    "appendix": r"\b(?:anhang|appendix|anlage)\b",
}
QUALITY_BOOST = {"excellent": 1.5, "good": 1.2, "moderate": 1.0, "poor": 0.7}
SAFETY_BOOST = {"critical": 1.8, "high": 1.4, "medium": 1.1, "low": 1.0, "none": 1.0}
PREREQUISITES = {"expert": ["Fachausbildung", "Zertifizierung", "Berufserfahrung"], "skilled": ["Einweisung", "Grundkenntnisse"], "trained": ["Schulung"], "basic": ["Grundverständnis"], "anyone": []}
CATEGORY_PREREQUISITES = {"safety": "Sicherheitsunterweisung", "maintenance": "Wartungsschulung", "troubleshooting": "Systemkenntnisse"}
CHUNK_SEPARATORS = ["\n\n# ", "\n\n## ", "\n\n### ", "\n\n", r"\n\d+\. ", "\n- ", "\n• ", "\n", ". ", " ", ""]
INDUSTRIAL_SEPARATORS = ["\n\n# ", "\n\n## ", "\n\nTechnische Daten:", "\n\nWARNUNG:", "\n\nHINWEIS:", "\n\nSchritt ", r"\n\d+\.\s+", "\n\n", "\n", ". ", " "]
STRUCTURE_PATTERNS = [(r"\n#{1,3}\s+.+\n", "header"), (r"\n\d+\.\s+.+\n", "numbered_list"), (r"\n[-•]\s+.+\n", "bullet_list"), (r"\n\n.+\n\n", "paragraph")]
CHUNK_CATEGORIES = [
    ("safety", ["warnung", "gefahr", "achtung", "warning", "danger"]),
    ("specifications", ["technische daten", "spezifikation", "parameter"]),
    ("installation", ["installation", "montage", "aufbau"]),
    ("operation", ["bedienung", "betrieb", "anwendung"]),
    ("maintenance", ["wartung", "instandhaltung", "service"]),
]
