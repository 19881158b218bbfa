"""Fixed values of the retail model.

Everything here is a constant of the business model (shop codes, word lists, lookup
tables, thresholds). Results depend on these exact values, so they are stated once, as
plain text, and imported everywhere else.
"""

# --- Shops -----------------------------------------------------------------------------
SHOP_NAMES = {
    "HIP": "PARIS MARAIS",
    "SED": "LYON PRESQUILE",
    "HPC": "MARSEILLE PRADO",
    "ACC": "NANTES COMMERCE",
}
SHOP_FOLDERS = {
    "fashion_center": "HIP",
    "sedaine": "SED",
    "demo": "HPC",
    "accessoires": "ACC",
}
SHOP_GROUPS = {"ALL": ("SED", "HIP")}
SHARED_REFERENTIAL_SHOPS = ("HIP", "SED", "HPC")
SHOP_PRIORITY = ("HIP", "SED", "HPC", "ACC")
MERGED_SHOP = "HIPP"

# --- Raw entities ----------------------------------------------------------------------
RAW_ENTITIES = (
    "SaleDocument",
    "SaleDocumentLine",
    "Item",
    "Customer",
    "StockItem",
    "StockMovement",
    "Storehouse",
)

# --- Periods ---------------------------------------------------------------------------
PERIOD_MONTHS = (0, 1, 2, 3, 6, 12, 24, 36)
RANGE_DAYS = (30, 60, 90, 180, 365)
RANGE_DAYS_MONTHLY = (180, 365, 730, 1095, 0)
RANGE_DAYS_WEEKLY = (90, 180, 365, 730)
WEEKDAY_LABELS = {1: "Dim", 2: "Lun", 3: "Mar", 4: "Mer", 5: "Jeu", 6: "Ven", 7: "Sam"}

# --- Places ----------------------------------------------------------------------------
FRANCE_GROUP = ("FR", "GP", "RE", "GF", "MQ", "YT", "PM", "BL", "MF")
COUNTRY_FIXES = {"COT": "CI", "ISR": "IL", "COL": "CO"}
CORSICA = ("2A", "2B")
METRO_BOX = {"lat": (41.0, 51.5), "lon": (-5.5, 10.0)}

# --- Names -----------------------------------------------------------------------------
LEGAL_FORMS = (
    "SARL", "SARLU", "SAS", "SASU", "SCEA", "SCOP", "EIRL", "SCI", "SCP", "SNC",
    "EURL", "GAEC", "GIE", "SCM", "EI", "SA", "SL",
)
UNUSABLE_NAMES = ("", "[ND]")

# --- Garment types: first matching pattern wins ----------------------------------------
GARMENT_RULES = (
    ("ROBE", r"ROBE"),
    ("VESTE", r"VESTE|BLAZER|VEST"),
    ("PANTALON", r"PANTALON|PANT\b"),
    ("JUPE", r"JUPE"),
    ("PULL", r"PULL|PULLOVER|SWEAT"),
    ("CHEMISIER", r"CHEMIS"),
    ("MANTEAU", r"MANTEAU|PARKA|MANT"),
    ("TOP", r"TOP\b|DEBARDEUR"),
    ("SHORT", r"SHORT"),
    ("SAC", r"SACS|SAC\b"),
)
GARMENT_DEFAULT = "AUTRE"
GARMENT_WORDS = (
    "ROBE", "VESTE", "PANTALON", "JUPE", "MANTEAU", "TOP", "CHEMISE", "PULL", "GILET",
    "COMBINAISON", "SHORT", "ENSEMBLE", "BLOUSE", "TUNIQUE", "CARDIGAN", "BLOUSON",
    "TRENCH", "PARKA",
)

# --- Shop tags: every matching pattern gives a tag -------------------------------------
SHOP_TAG_RULES = (
    ("femme", "FEMME|FEMMES|LADY|LADIES|ELLE|WOMAN|WOMEN|MISS|MADAME|MADEMOISELLE|GIRL|GIRLS"),
    ("homme", "HOMME|HOMMES|MEN|GENT|MASCULIN|MR|MISTER"),
    ("enfant", "ENFANT|ENFANTS|KIDS|BABY|BEBE|JUNIOR|MINI|MOMES|BAMBINI|MAMAN"),
    ("sport", "SPORT|FITNESS|RUNNING|GYM|JOGGING|OUTDOOR|TRAIL|YOGA"),
    ("mariage", "MARIAGE|MARIEE|CEREMONIE|NUPTIAL|EPOUS|WEDDING"),
    ("friperie", "FRIPERIE|VINTAGE|TROC|DEPOT.?VENTE|SECONDE.?MAIN|OCCASION"),
    ("lingerie", "LINGERIE|SOUS.?VETEMENT|INTIM|CORSET|BUSTIER"),
    ("luxe", "LUXE|LUXURY|COUTURE|HAUTE.?COUTURE|PREMIUM"),
    ("grande_taille", "GRANDE.?TAILLE|XXL|CURVE|PLUS.?SIZE|RONDE|RONDES"),
)
UNTAGGED = "indetermine"

# --- Documents, movements, statuses ----------------------------------------------------
DOCUMENT_LABELS = {2: "Facture", 3: "Avoir", 1: "Commande"}
DOCUMENT_LABEL_DEFAULT = "Autre"
INVOICE_TYPE = 2
MOVEMENT_LABELS = {
    ("0", "2"): "achat",
    ("1", "4"): "vente",
    ("1", "5"): "sortie_autre",
    ("1", "6"): "transfert",
}
MOVEMENT_DEFAULT = "autre"
REORDER_ORDER = ("en_retard", "du_semaine", "a_venir", "insuffisant")
CHURN_ORDER = ("critique", "modere", "surveillance")
PROSPECT_STATUSES = ("a_contacter", "contacte", "pas_interesse")
PROSPECT_STATUS_DEFAULT = "a_contacter"
LEGAL_BUCKETS = ("societe", "ei", "autre")
NOTE_MAX_CHARS = 500

# --- Open company register -------------------------------------------------------------
REGISTER_ACTIVITY = "47.71Z"
REGISTER_ACTIVE = "A"
ESTABLISHMENT_COLUMNS = (
    "siret", "siren", "nic",
    "denominationUsuelleEtablissement",
    "denominationUniteLegale",
    "enseigne1Etablissement",
    "numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement",
    "complementAdresseEtablissement",
    "codePostalEtablissement", "libelleCommuneEtablissement", "codeCommuneEtablissement",
    "dateCreationEtablissement",
    "trancheEffectifsEtablissement",
    "activitePrincipaleEtablissement",
    "etatAdministratifEtablissement",
)
LEGAL_UNIT_COLUMNS = (
    "siren",
    "denominationUniteLegale",
    "categorieJuridiqueUniteLegale",
    "nomUniteLegale",
    "prenomUsuelUniteLegale",
    "nomUsageUniteLegale",
    "dateCreationUniteLegale",
    "etatAdministratifUniteLegale",
)
HEADCOUNT_LABELS = {
    "NN": "Non employeur ou inconnu",
    "00": "0 salarié",
    "01": "1 ou 2 salariés",
    "02": "3 à 5 salariés",
    "03": "6 à 9 salariés",
    "11": "10 à 19 salariés",
    "12": "20 à 49 salariés",
    "21": "50 à 99 salariés",
    "22": "100 à 199 salariés",
    "31": "200 à 249 salariés",
    "32": "250 à 499 salariés",
    "41": "500 à 999 salariés",
    "42": "1 000 à 1 999 salariés",
    "51": "2 000 à 4 999 salariés",
    "52": "5 000 à 9 999 salariés",
    "53": "10 000 salariés et plus",
}
NO_HEADCOUNT = ("NN", "00")
EXPORT_COLUMNS = (
    "siret", "siren", "denomination", "adresse_voie", "adresse_complement", "zip_code",
    "city", "dept_code", "date_creation", "tranche_effectif_code",
    "tranche_effectif_libelle", "statut", "note", "dernier_contact", "updated_at",
)

# --- Countries: ISO 3166 code, three-letter code, French name --------------------------
COUNTRIES = (
    ("BE", "BEL", "Belgique"),
    ("DE", "DEU", "Allemagne"),
    ("GB", "GBR", "Royaume-Uni"),
    ("IT", "ITA", "Italie"),
    ("ES", "ESP", "Espagne"),
    ("NL", "NLD", "Pays-Bas"),
    ("CH", "CHE", "Suisse"),
    ("LU", "LUX", "Luxembourg"),
    ("PT", "PRT", "Portugal"),
    ("AT", "AUT", "Autriche"),
    ("PL", "POL", "Pologne"),
    ("SE", "SWE", "Suède"),
    ("NO", "NOR", "Norvège"),
    ("DK", "DNK", "Danemark"),
    ("FI", "FIN", "Finlande"),
    ("IE", "IRL", "Irlande"),
    ("GR", "GRC", "Grèce"),
    ("CZ", "CZE", "Rép. tchèque"),
    ("HU", "HUN", "Hongrie"),
    ("RO", "ROU", "Roumanie"),
    ("MA", "MAR", "Maroc"),
    ("TN", "TUN", "Tunisie"),
    ("DZ", "DZA", "Algérie"),
    ("US", "USA", "États-Unis"),
    ("CA", "CAN", "Canada"),
    ("JP", "JPN", "Japon"),
    ("AU", "AUS", "Australie"),
    ("AE", "ARE", "Émirats arabes unis"),
    ("MC", "MCO", "Monaco"),
)
