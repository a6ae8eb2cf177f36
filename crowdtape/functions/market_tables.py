"""Market names, sessions, currency and contract names, themes and their patterns.

They are data, not logic: results must agree with them, so they are listed plainly.
"""

US = "America/New_York"
# exchange code -> market, time zone, trading days, open, close, midday break
EXCHANGES = [
    ("NMS", "NASDAQ", US, "Mon-Fri", "09:30", "16:00", ""),
    ("NASDAQ", "NASDAQ", US, "Mon-Fri", "09:30", "16:00", ""),
    ("NYQ", "NYSE", US, "Mon-Fri", "09:30", "16:00", ""),
    ("NYSE", "NYSE", US, "Mon-Fri", "09:30", "16:00", ""),
    ("ASE", "NYSE American", US, "Mon-Fri", "09:30", "16:00", ""),
    ("AMEX", "NYSE American", US, "Mon-Fri", "09:30", "16:00", ""),
    ("PCX", "NYSE Arca", US, "Mon-Fri", "09:30", "16:00", ""),
    ("BATS", "Cboe BZX", US, "Mon-Fri", "09:30", "16:00", ""),
    ("PNK", "OTC Pink", US, "Mon-Fri", "09:30", "16:00", ""),
    ("OTC", "OTC Markets", US, "Mon-Fri", "09:30", "16:00", ""),
    ("OTCQB", "OTCQB", US, "Mon-Fri", "09:30", "16:00", ""),
    ("OTCQX", "OTCQX", US, "Mon-Fri", "09:30", "16:00", ""),
    ("LSE", "LSE", "Europe/London", "Mon-Fri", "08:00", "16:30", ""),
    ("XETRA", "XETRA", "Europe/Berlin", "Mon-Fri", "09:00", "17:30", ""),
    ("FRA", "Frankfurt", "Europe/Berlin", "Mon-Fri", "08:00", "20:00", ""),
    ("PAR", "Euronext Paris", "Europe/Paris", "Mon-Fri", "09:00", "17:30", ""),
    ("AMS", "Euronext Amsterdam", "Europe/Amsterdam", "Mon-Fri", "09:00", "17:40", ""),
    ("BRU", "Euronext Brussels", "Europe/Brussels", "Mon-Fri", "09:00", "17:30", ""),
    ("MIL", "Borsa Italiana", "Europe/Rome", "Mon-Fri", "09:00", "17:30", ""),
    ("MAD", "Bolsa de Madrid", "Europe/Madrid", "Mon-Fri", "09:00", "17:30", ""),
    ("SIX", "SIX Swiss", "Europe/Zurich", "Mon-Fri", "09:00", "17:30", ""),
    ("TOR", "TSX", "America/Toronto", "Mon-Fri", "09:30", "16:00", ""),
    ("TSX", "TSX", "America/Toronto", "Mon-Fri", "09:30", "16:00", ""),
    ("VAN", "TSX Venture", "America/Toronto", "Mon-Fri", "09:30", "16:00", ""),
    ("TSXV", "TSX Venture", "America/Toronto", "Mon-Fri", "09:30", "16:00", ""),
    ("NEO", "NEO", "America/Toronto", "Mon-Fri", "09:30", "16:00", ""),
    ("TSE", "Tokyo (TSE)", "Asia/Tokyo", "Mon-Fri", "09:00", "15:00", "11:30,12:30"),
    ("JPX", "Tokyo (TSE)", "Asia/Tokyo", "Mon-Fri", "09:00", "15:00", "11:30,12:30"),
    ("HKG", "Hong Kong (HKEX)", "Asia/Hong_Kong", "Mon-Fri", "09:30", "16:00", "12:00,13:00"),
    ("ASX", "ASX", "Australia/Sydney", "Mon-Fri", "10:00", "16:00", ""),
    ("SHG", "Shanghai (SSE)", "Asia/Shanghai", "Mon-Fri", "09:30", "15:00", "11:30,13:00"),
    ("SHE", "Shenzhen (SZSE)", "Asia/Shanghai", "Mon-Fri", "09:30", "15:00", "11:30,13:00"),
    ("SES", "Singapore (SGX)", "Asia/Singapore", "Mon-Fri", "09:00", "17:00", ""),
    ("KSC", "Korea (KRX)", "Asia/Seoul", "Mon-Fri", "09:00", "15:30", ""),
    ("KOSDAQ", "KOSDAQ", "Asia/Seoul", "Mon-Fri", "09:00", "15:30", ""),
    ("TPE", "Taiwan (TWSE)", "Asia/Taipei", "Mon-Fri", "09:00", "13:30", ""),
    ("SAO", "B3 (Brazil)", "America/Sao_Paulo", "Mon-Fri", "10:00", "17:30", ""),
    ("MEX", "BMV (Mexico)", "America/Mexico_City", "Mon-Fri", "08:30", "15:00", ""),
    ("JSE", "JSE (South Africa)", "Africa/Johannesburg", "Mon-Fri", "09:00", "17:00", ""),
]
SPECIAL_EXCHANGES = {
    "fx": ("SPECIAL", "FOREX", "Etc/UTC", "Mon-Fri", "00:00", "23:59", ""),
    "crypto": ("SPECIAL", "CRYPTO", "Etc/UTC", "Mon-Sun", "00:00", "23:59", ""),
    "futures": ("SPECIAL", "FUTURES", US, "Sun-Fri", "18:00", "17:00", ""),
    "fallback": ("FALLBACK", "UNKNOWN", US, "Mon-Fri", "09:30", "16:00", ""),
}
# market words -> symbol suffix of the price vendor, in order of precedence
SUFFIXES = [
    ("NYSE", ""), ("NASDAQ", ""), ("NYQ", ""), ("NMS", ""), ("NCM", ""), ("NQSM", ""), ("ARCA", ""),
    ("NYSEARCA", ""), ("CBOE", ""), ("BATS", ""), ("PCX", ""), ("LSE", ".L"), ("LONDON", ".L"),
    ("EURONEXT PARIS", ".PA"), ("PARIS", ".PA"), ("EPA", ".PA"), ("EURONEXT AMSTERDAM", ".AS"),
    ("AMSTERDAM", ".AS"), ("EURONEXT BRUSSELS", ".BR"), ("BRUSSELS", ".BR"), ("FRANKFURT", ".DE"),
    ("XETRA", ".DE"), ("MILAN", ".MI"), ("BIT", ".MI"), ("MADRID", ".MC"), ("COPENHAGEN", ".CO"),
    ("STOCKHOLM", ".ST"), ("HELSINKI", ".HE"), ("OSLO", ".OL"), ("SIX", ".SW"), ("SWISS", ".SW"),
    ("TSX", ".TO"), ("TORONTO", ".TO"), ("TSXV", ".V"), ("VENTURE", ".V"), ("MEXICO", ".MX"),
    ("BOLSA MEXICANA", ".MX"), ("SÃO PAULO", ".SA"), ("SAO PAULO", ".SA"), ("B3", ".SA"),
    ("ASX", ".AX"), ("TSE", ".T"), ("TOKYO", ".T"), ("HONG KONG", ".HK"), ("HKEX", ".HK"),
    ("NSE", ".NS"), ("NATIONAL STOCK EXCHANGE OF INDIA", ".NS"), ("BSE", ".BO"), ("BOMBAY", ".BO"),
]
PROBE_SUFFIXES = [
    "", ".L", ".TO", ".V", ".PA", ".AS", ".BR", ".DE", ".MI", ".MC", ".CO", ".ST", ".HE", ".OL",
    ".SW", ".AX", ".T", ".HK", ".NS", ".BO", ".KS", ".KQ", ".TW", ".TWO", ".SA", ".MX",
]
DEAD_ALIASES = ["ASCX", "ATT", "AV", "AVNRL"]
MAJOR_CURRENCIES = ["EUR", "USD", "JPY", "GBP", "AUD", "NZD", "CAD", "CHF"]
CURRENCY_NAMES = {
    "USD": "US dollar", "EUR": "Euro", "JPY": "Japanese yen", "GBP": "British pound",
    "AUD": "Australian dollar", "NZD": "New Zealand dollar", "CAD": "Canadian dollar",
    "CHF": "Swiss franc", "CNY": "Chinese yuan", "CNH": "Offshore yuan", "MXN": "Mexican peso",
    "BRL": "Brazilian real",
}
# futures root -> name, sector, theme
FUTURES = {
    "CL": ("WTI crude oil", "Energy", "oil_gas"), "BZ": ("Brent crude oil", "Energy", "oil_gas"),
    "NG": ("natural gas", "Energy", "oil_gas"), "HO": ("heating oil", "Energy", "oil_gas"),
    "RB": ("RBOB gasoline", "Energy", "oil_gas"), "GC": ("gold", "Materials", "gold"),
    "SI": ("silver", "Materials", "silver"), "HG": ("copper", "Materials", "copper"),
    "PL": ("platinum", "Materials", "chemicals"), "PA": ("palladium", "Materials", "chemicals"),
    "ALI": ("aluminum", "Materials", "aluminum"), "ZC": ("corn", "Materials", "agriculture"),
    "ZW": ("wheat", "Materials", "agriculture"), "ZS": ("soybeans", "Materials", "agriculture"),
    "ZM": ("soybean meal", "Materials", "agriculture"), "ZL": ("soybean oil", "Materials", "agriculture"),
    "ZO": ("oats", "Materials", "agriculture"), "KE": ("KC wheat", "Materials", "agriculture"),
    "ZR": ("rough rice", "Materials", "agriculture"), "KC": ("coffee", "Materials", "agriculture"),
    "SB": ("sugar", "Materials", "agriculture"), "CC": ("cocoa", "Materials", "agriculture"),
    "CT": ("cotton", "Materials", "agriculture"), "OJ": ("orange juice", "Materials", "agriculture"),
    "ES": ("S&P 500", None, "index"), "NQ": ("Nasdaq 100", None, "index"),
    "YM": ("Dow Jones", None, "index"), "RTY": ("Russell 2000", None, "index"),
    "ZN": ("10-year T-Note", None, "rates"), "ZB": ("30-year T-Bond", None, "rates"),
    "ZF": ("5-year T-Note", None, "rates"), "ZT": ("2-year T-Note", None, "rates"),
}
CRYPTO_NAMES = {
    "BTC": "Bitcoin", "ETH": "Ethereum", "SOL": "Solana", "BNB": "BNB", "ADA": "Cardano",
    "XRP": "XRP", "DOGE": "Dogecoin", "AVAX": "Avalanche", "DOT": "Polkadot", "ATOM": "Cosmos",
}
SECTOR_FUNDS = {
    "Information Technology": "XLK", "Health Care": "XLV", "Financials": "XLF",
    "Consumer Discretionary": "XLY", "Consumer Staples": "XLP", "Energy": "XLE",
    "Industrials": "XLI", "Materials": "XLB", "Real Estate": "XLRE",
    "Communication Services": "XLC", "Utilities": "XLU",
}
# theme -> (pattern, proxy funds)
THEMES = {
    "gold": (r"\bgold\b|\bau\b|precious metal", "GLD, GDX, IAU, GDXJ"),
    "silver": (r"\bsilver\b|\bXAG\b", "SLV, SIL"),
    "copper": (r"\bcopper\b|porphyry|\bcu\b", "CPER, COPX"),
    "lithium": (r"\blithium\b|spodumene|sal\s*de\s*vida|brine", "LIT"),
    "uranium": (r"\buranium\b|\bU3O8\b", "URA, URNM"),
    "steel": (r"\bsteel\b", "SLX"),
    "aluminum": (r"\balumin(i)?um\b", "JJU"),
    "coal": (r"\bcoal\b", "KOL"),
    "oil_gas": (r"\boil\b|brent|wti|natural gas|\bngl\b", "XLE, XOP, IEO, VDE"),
    "renewables": (r"renewable|wind|solar|hydro|geothermal", "ICLN, TAN"),
    "solar": (r"\bsolar\b|photovoltaic|\bpv\b", "TAN"),
    "nuclear": (r"\bnuclear\b|\breactor\b|\bSMR\b", "NLR, URA"),
    "hydrogen": (r"\bhydrogen\b|\bH2\b|electrolyzer", "HDRO"),
    "battery_storage": (r"battery|anode|cathode|lithium-ion|solid-state", "LIT, BATT"),
    "semiconductors": (r"\bsemi|wafer|foundry|fab|\bEDA\b|nvidia|\bamd\b|intel", "SMH, SOXX, SOXQ, XSD"),
    "ai": (r"\bAI\b|machine learning|deep learning|\bLLM\b|accelerator|\bGPU\b", "BOTZ, IRBO, QQQ"),
    "cloud": (r"\bcloud\b|\bSaaS\b|hyperscaler|aws|azure|\bgcp\b", "WCLD, SKYY"),
    "software": (r"\bsoftware\b|\bdevops\b|subscription|platform", "IGV, VGT"),
    "cybersecurity": (r"cyber|endpoint|firewall|zero trust|\bSIEM\b|\bXDR\b", "HACK, CIBR"),
    "hardware": (r"\bhardware\b|peripheral|server|storage|\bPC\b|laptop", "VGT"),
    "networking": (r"network|router|switch|5g|optical|datacenter", "IGN"),
    "fintech": (r"fintech|payments|wallet|\bBNPL\b", "FINX, IPAY"),
    "banks": (r"\bbank\b|lender|credit union", "KBE, KRE, XLF"),
    "insurance": (r"insurance|reinsurance", "KIE"),
    "asset_management": (r"asset management|\bETF\b|brokerage", "XLF"),
    "biotech": (r"biotech|therapeutic|oncology|biopharma|gene therapy", "XBI, IBB"),
    "pharma": (r"pharma|\bdrug\b|\bFDA\b|pipeline", "IHE, PJP"),
    "medtech": (r"medical device|diagnostic|imaging|implant", "IHI"),
    "aerospace_defense": (r"aerospace|defense|missile|satellite", "ITA, DFEN"),
    "autos": (r"automotive|\bOEM\b|auto parts", "CARZ"),
    "ev": (r"\bEV\b|electric vehicle|charging", "DRIV, IDRV, KARS"),
    "airlines": (r"\bairline(s)?\b|\bair\s*carrier(s)?\b", "JETS"),
    "shipping": (
        r"\bshipping\b|\bcontainerships?\b|\bcontainer\s*ship(s)?\b|\btanker(s)?\b|\bdry\s*bulk\b"
        r"|\bbaltic\s*dry\b|\bcharter(er|ing)?\b|\bfreight\s*rate(s)?\b", "SEA"),
    "rail": (r"\brail\b|railroad|railway", "XTN"),
    "retail": (r"retail|department store|apparel", "XRT"),
    "ecommerce": (r"e-?commerce|marketplace|online retail", "EBIZ, ONLN"),
    "media_streaming": (r"streaming|\bOTT\b|content platform", "XLC"),
    "gaming": (r"videogame|publisher|esports", "HERO, ESPO"),
    "reit": (r"\bREIT\b|real estate investment trust", "VNQ, XLRE"),
    "utilities": (r"utility|electric power|water utility|gas utility", "XLU"),
    "grid_infra": (r"transmission|distribution|substation|grid|inverter", "PAVE"),
    "chemicals": (r"chemical|specialty chemicals", "XLB"),
    "fertilizers": (r"fertilizer|potash|phosphate|ammonia|\bNPK\b", "MOO, SOIL"),
    "agriculture": (r"agricultur|farm|seed|crop|tractor|agtech", "MOO"),
    "cannabis": (r"cannabis|marijuana|\bTHC\b|\bCBD\b", "MSOS, MJ"),
    "crypto_blockchain": (r"crypto|bitcoin|ethereum|blockchain|\bweb3\b", "BITQ, BLOK, WGMI"),
}
SECTOR_BIAS = {
    "information technology": ["ai", "cloud", "software", "cybersecurity", "semiconductors", "hardware", "networking"],
    "health care": ["biotech", "pharma", "medtech"],
    "energy": ["oil_gas", "renewables", "solar", "nuclear", "hydrogen", "battery_storage"],
    "materials": ["steel", "aluminum", "chemicals", "fertilizers", "copper", "lithium", "gold", "silver", "uranium"],
}
HARD_TYPES = ["ETF", "ADR", "SPAC?", "REIT", "TRUST", "WARRANT", "UNIT", "RIGHTS", "FOREX", "FUTURES", "CRYPTO"]
EQUITY_TYPES = ["EQUITY", "ADR", "ETF"]
# vendor's exchange label -> market, code
EXCHANGE_LABELS = {
    "NYSEARCA": ("NYSE Arca", "PCX"), "ARCA": ("NYSE Arca", "PCX"), "NYSE": ("NYSE", "NYQ"),
    "NASDAQGS": ("NASDAQ", "NMS"), "NASDAQ GM": ("NASDAQ", "NGM"), "NASDAQCM": ("NASDAQ", "NCM"),
    "NASDAQ": ("NASDAQ", "NMS"), "BATS": ("Cboe BZX", "BATS"), "CBOE": ("Cboe BZX", "BATS"),
    "CBOE US": ("Cboe BZX", "BATS"), "CBOE BZX": ("Cboe BZX", "BATS"), "AMEX": ("NYSE American", "ASE"),
    "NYSEAMERICAN": ("NYSE American", "ASE"), "TSX": ("TSX", "TSX"), "TSXV": ("TSX Venture", "TSXV"),
}
