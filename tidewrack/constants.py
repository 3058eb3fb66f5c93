"""Vocabularies and thresholds of the domain. All values here are fixed values: results depend on them."""

# Target environments; the order decides ties.
ENVIRONMENTS = ["Open_ocean", "Coastal_waters", "Lake", "Wetlands"]
OTHER_ENVIRONMENT = "Others"

# Thresholds of classification (all comparisons strict), presence, tiers and significance.
H_UNIVERSAL, PAPERS_UNIVERSAL = 0.85, 50
PAPERS_CROSS = 30
H_SIGNATURE, SHARE_SIGNATURE, PAPERS_SIGNATURE = 0.4, 0.7, 5
MAINSTREAM_PAPERS = 3
TIER2_PAPERS = 3
PRESENT_PAPERS, PRESENT_PERCENT = 5, 0.5
ALPHA, ENRICHED = 0.05, 2.0
ALTERNATES = 3
MISSING_YEAR = 9999

# Relations by priority (lowest first).
RELATIONS = ["unknown", "label-metadata", "accession-metadata", "accession-label", "accession-label-metadata"]

# Levels in hoisting order.
LEVELS = ["biosample", "sra_sample", "sra_experiment", "sra_run", "bioproject", "sra_study"]

# Accession patterns of the public sequence archives, and level by prefix.
ACCESSION = r"\b(PRJ[NEDB][AB]\d+|SAM[EN]A?\d+|SAMD\d+|[SED]RX\d+|[SED]RR\d+|[SED]RP\d+|[SED]RS\d+)\b"
LEVEL_OF_PREFIX = {
    "SAMEA": "biosample", "SAMN": "biosample", "SAMD": "biosample", "PRJNA": "bioproject", "PRJEB": "bioproject", "PRJDB": "bioproject",
    "PRJDA": "bioproject", "SRS": "sra_sample", "ERS": "sra_sample", "DRS": "sra_sample", "SRX": "sra_experiment", "ERX": "sra_experiment",
    "DRX": "sra_experiment", "SRR": "sra_run", "ERR": "sra_run", "DRR": "sra_run", "SRP": "sra_study", "ERP": "sra_study", "DRP": "sra_study",
}

# Unit spellings (lower case) of each canonical unit.
UNITS = {
    "meter": ["m", "meter", "meters", "metre", "metres"],
    "kilometer": ["km", "kilometer", "kilometers"],
    "centimeter": ["cm", "centimeter", "centimeters"],
    "millimeter": ["mm", "millimeter", "millimeters"],
    "micrometer": ["um", "µm", "μm", "micrometer", "micrometers", "micron", "microns"],
    "nanometer": ["nm", "nanometer", "nanometers"],
    "degC": ["c", "°c", "degc", "degree celsius", "degrees celsius", "celsius"],
    "K": ["k", "kelvin"],
    "degF": ["f", "°f", "degf", "fahrenheit", "degree fahrenheit"],
    "mg/L": ["mg/l", "milligram per liter", "mg per l"],
    "ug/L": ["ug/l", "µg/l", "μg/l", "microgram per liter"],
    "ng/L": ["ng/l", "nanogram per liter"],
    "uM": ["um_conc", "umol/l", "µmol/l", "μmol/l", "micromole per liter"],
    "umol/kg": ["umol/kg", "µmol/kg", "μmol/kg", "micromole per kilogram"],
    "mM": ["mmol/l", "millimole per liter"],
    "M": ["mol/l", "mole per liter"],
    "ppm": ["ppm", "parts per million"],
    "ppb": ["ppb", "parts per billion"],
    "percent": ["%", "percent", "percentage"],
    "PSU": ["psu", "practical salinity unit", "pss", "pss-78", "pss78"],
    "pH": ["ph unit", "ph", "ph_unit"],
    "second": ["s", "sec", "second", "seconds"],
    "minute": ["min", "minute", "minutes"],
    "hour": ["h", "hr", "hour", "hours"],
    "day": ["d", "day", "days"],
    "gram": ["g", "gram", "grams"],
    "milligram": ["mg", "milligram", "milligrams"],
    "kilogram": ["kg", "kilogram", "kilograms"],
    "ton": ["ton", "tons", "tonne", "tonnes"],
    "liter": ["l", "liter", "litre", "litres"],
    "milliliter": ["ml", "milliliter", "millilitre", "millilitres"],
    "bar": ["bar"], "dbar": ["dbar"], "Pa": ["pa"], "kPa": ["kpa"], "MPa": ["mpa"],
    "atm": ["atm", "atmosphere"],
    "g/cm3": ["g/cm3", "g/cm^3"], "kg/m3": ["kg/m3"], "g/mL": ["g/ml"], "g/L": ["g/l"],
    "m/s": ["m/s"], "cm/s": ["cm/s"], "knot": ["knot", "knots"],
    "umol photons/m2/s": ["uein/m2/s", "umol/m2/s", "µmol/m²/s", "μmol/m²/s"],
    "g/m3": ["g/m3"], "mg/m3": ["mg/m3"],
    "cells/mL": ["cells/ml"], "cells/L": ["cells/l"], "copies/mL": ["copies/ml"], "copies/L": ["copies/l"],
}

# Vocabularies of field-name decomposition.
STOPWORDS = "of in the and or to from by for with on a an per into onto up down is are was were not no".split()
STAT_SUFFIXES = "sd stdev std standard_deviation se stderr standard_error err error mean avg average median min minimum max maximum range var variance cv rsd iqr count".split()
STAT_PREFIXES = "mean avg average median min minimum max maximum sum".split()
UNIT_SUFFIXES = (
    "mg_l mgl mgl1 ug_l ugl ugl1 ng_l ngl mg_ml g_l gl gl1 umol_l umoll umol_per_l micromolar umolar nmol_l nmoll mmol_l mmoll mol_l moll pmol_l pmoll "
    "umol_kg umol_kg1 umolkg nmol_kg nmolkg mmol_kg mmol_kg1 mmolkg mol_kg mol_kg1 molkg mg_kg mgkg mgkg1 ug_kg ugkg ng_kg ngkg mg_g mgg ug_g ugg mg_m3 mgm3 ug_m3 ugm3 "
    "ppm ppb ppt psu practical_salinity_units m km cm mm um nm ha km2 m2 cm2 mm2 acres hectare hectares ml ul m3 cm3 l kg mg ug ng "
    "y_bp yr_bp yrs_bp ybp yrbp ka ma ky kyr kyr_bp kybp cal_bp cal_yr_bp calbp days hours minutes seconds bq_kg bq_l bq_m3 bqkg bql pci_l pcil "
    "atm bar mbar psi kpa mpa pa hpa degc degree_celsius degrees_celsius celsius degf degree_fahrenheit kelvin uatm ppmv meq_l meql meql1 mg_l_caco3 ppm_caco3 percent percentage pct ratio"
).split()
QUALIFIER_SUFFIXES = "concentration concentrations conc level levels amount amounts".split()
AGGREGATION_PREFIXES = "annual yearly monthly weekly daily hourly seasonal diurnal mean_annual mean_monthly mean_daily average_annual average_monthly".split()
ISOTOPES = "13c 14c 12c 15n 14n 18o 17o 16o 2h 3h 34s 32s 33s 36s 137cs 134cs 87sr 86sr 210pb 206pb 207pb 208pb 204pb 226ra 228ra 224ra 223ra 40ar 36cl 3he 4he 222rn 7be 10be 230th 234u 238u".split()
TAXA = "archaeal archaea bacterial bacteria fungal fungi viral virus viruses eukaryotic eukaryote eukaryotes prokaryotic prokaryote prokaryotes cyanobacterial cyanobacteria protist protists microbial".split()
SUBSTANCES = {
    "carbon": "carbon c co2 co3 hco3 co ch4 carbonate bicarbonate methane toc doc dic poc".split(),
    "nitrogen": "nitrogen n no3 no2 nh4 nh3 n2 n2o ammonia ammonium nitrate nitrite ton don tn pon tdn".split(),
    "phosphorus": "phosphorus phosphorous p po4 po43 phosphate tp dop tdp pop".split(),
    "sulfur": "sulfur sulphur s so4 so42 h2s sulfate sulphate".split(),
    "oxygen": "oxygen o o2 o3".split(), "hydrogen": "hydrogen h h2".split(), "silicon": "silicon silica si sio2 sio3 sio4".split(),
    "iron": "iron fe".split(), "manganese": "manganese mn".split(), "calcium": "calcium ca".split(), "magnesium": "magnesium mg".split(),
    "sodium": "sodium na".split(), "potassium": "potassium k".split(), "copper": "copper cu".split(), "zinc": "zinc zn".split(),
    "lead": "lead pb".split(), "mercury": "mercury hg".split(), "cadmium": "cadmium cd".split(), "arsenic": "arsenic as".split(),
    "chromium": "chromium cr".split(), "nickel": "nickel ni".split(), "aluminum": "aluminum aluminium al".split(),
    "chlorine": "chlorine chloride cl".split(), "fluorine": "fluorine fluoride f".split(), "bromine": "bromine bromide br".split(),
    "boron": "boron b".split(), "chlorophyll": "chlorophyll chl chla".split(),
}

# Unit endings taken off before names are compared, tried in this order, and thresholds of similarity.
SIMILARITY_SUFFIXES = ["_nmol_kg", "_nmolkg", "_g_kg", "_gkg", "_percent", "_pct", "_pc", "_m", "_cm", "_mm", "_km", "_degc", "_degk"]
TOKEN_JACCARD, EDIT_CAP, EDIT_RATIO, SUBSTRING_RATIO = 0.5, 2, 0.3, 0.5
LABEL_OVERLAP, ONTOLOGY_OVERLAP = 0.5, 0.7
