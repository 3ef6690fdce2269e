"""Other words for the canonical weather conditions and months, in plain lists."""

from __future__ import annotations

# Whole phrases by field and canonical value.
PHRASES = {
    "weather_condition": {
        "CLEAR": ("SUNSHINE", "SUNNY", "CLOUDLESS", "CLEAR SKIES", "CLEAR SKY", "FAIR", "FAIR WEATHER", "BLUE SKY", "DESPEJADO", "SOLEADO", "CIELO DESPEJADO", "ENSOLEILLE", "SONNIG", "KLAR"),
        "CLOUDY": ("CLOUD COVER", "GRAY SKY", "GREY SKY", "GRAY SKIES", "GREY SKIES", "DULL", "NUBLADO", "NUBOSO", "CUBIERTO", "NUAGEUX", "COUVERT", "BEWOLKT"),
        "RAIN": ("DOWNPOUR", "WET", "POURING", "LLUVIA", "LLUVIOSO", "LLOVIZNA", "LLOVIENDO", "PLUIE", "REGEN", "PIOGGIA", "CHUVA", "MIZZLE"),
        "SNOW": ("FLURRIES", "BLIZZARD", "WHITEOUT", "NIEVE", "NEVANDO", "NEVADA", "NEIGE", "SCHNEE", "NEVE", "SNEEUW"),
        "FOG": ("MIST", "MISTY", "HAZE", "FOGBANK", "FOG BANK", "SMOKE", "NIEBLA", "NEBLINA", "BRUMA", "BROUILLARD", "NEBEL", "NEBBIA", "NEVOEIRO"),
        "SLEET": ("ICE PELLETS", "SNOW MIXED WITH RAIN", "RAIN AND SNOW MIX", "RAIN AND SNOW MIXED", "WINTRY MIX", "AGUANIEVE"),
        "HAIL": ("HAILSTONES", "HAILSTORM", "GRANIZO", "PEDRISCO", "GRELE", "HAGEL"),
        "FREEZING RAIN": ("ICY RAIN", "FRZ RAIN", "FREEZING DRIZZLE", "ICE STORM", "GLAZE", "LLUVIA HELADA", "LLUVIA ENGELANTE", "PLUIE VERGLACANTE"),
        "HIGH WIND": ("WINDY", "GALE", "GALES", "STRONG WIND", "SEVERE CROSSWIND", "SEVERE CROSS WIND GATE", "VIENTO FUERTE", "VENDAVAL", "VENT FORT"),
        "BLOWING DUST": ("DUST STORM", "DUSTSTORM", "SANDSTORM", "SAND STORM", "BLOWING SAND", "POLVO", "TORMENTA DE ARENA", "TORMENTA DE POLVO", "TOLVANERA"),
        "UNKNOWN": ("UNDETERMINED", "NOT DETERMINED", "COULD NOT BE DETERMINED", "UNABLE TO DETERMINE", "NOT RECORDED", "NOT REPORTED", "DESCONOCIDO", "DESCONOCIDA", "INCONNU", "UNBEKANNT"),
    },
    "crash_month": {
        "JANUARY": ("ENERO", "JANVIER", "JANUAR", "GENNAIO", "JANEIRO", "JANUARI", "STYCZEN"),
        "FEBRUARY": ("FEBRERO", "FEVRIER", "FEBRUAR", "FEBBRAIO", "FEVEREIRO", "FEBRUARI", "LUTY"),
        "MARCH": ("MARZO", "MARS", "MAERZ", "MARZ", "MRZ", "MARCO", "MAART", "MARZEC"),
        "APRIL": ("ABRIL", "AVRIL", "APRILE", "ABR", "KWIECIEN"),
        "MAY": ("MAYO", "MAI", "MAGGIO", "MAIO", "MEI", "MAJ"),
        "JUNE": ("JUNIO", "JUIN", "JUNI", "GIUGNO", "JUNHO", "CZERWIEC"),
        "JULY": ("JULIO", "JUILLET", "JULI", "LUGLIO", "JULHO", "LIPIEC"),
        "AUGUST": ("AGOSTO", "AOUT", "AGO", "AUGUSTUS", "SIERPIEN"),
        "SEPTEMBER": ("SEPTIEMBRE", "SETIEMBRE", "SEPTEMBRE", "SETTEMBRE", "SETEMBRO", "WRZESIEN"),
        "OCTOBER": ("OCTUBRE", "OCTOBRE", "OKTOBER", "OTTOBRE", "OUTUBRO", "OKT", "PAZDZIERNIK"),
        "NOVEMBER": ("NOVIEMBRE", "NOVEMBRE", "NOVEMBRO", "LISTOPAD"),
        "DECEMBER": ("DICIEMBRE", "DECEMBRE", "DEZEMBER", "DICEMBRE", "DEZEMBRO", "DIC", "DEZ", "GRUDZIEN"),
    },
}

# Words of a description that speak for a canonical value.
WORDS = {
    "weather_condition": {
        "CLEAR": ("CLEAR", "SUNNY", "SUNSHINE", "CLOUDLESS"),
        "CLOUDY": ("CLOUDY", "CLOUDS", "CLOUD", "OVERCAST"),
        "RAIN": ("RAIN", "RAINY", "RAINING", "RAINFALL", "DRIZZLE", "DRIZZLING", "SHOWER", "SHOWERS", "DOWNPOUR"),
        "SNOW": ("SNOW", "SNOWY", "SNOWING", "SNOWFALL", "SNOWSTORM", "FLURRIES", "BLIZZARD"),
        "FOG": ("FOG", "FOGGY", "MIST", "MISTY"),
        "SLEET": ("SLEET", "SLEETING", "SLEETY"),
        "HAIL": ("HAIL", "HAILING", "HAILSTONES", "HAILSTORM"),
        "HIGH WIND": ("WINDS", "WIND", "WINDY", "GUSTS", "GUSTY", "GALE", "GALES"),
        "BLOWING DUST": ("DUST", "DUSTY", "SANDSTORM"),
    },
}

# Words that only say how, how much or when.
MODIFIERS = {
    "weather_condition": (
        "A", "ACROSS", "ALL", "AND", "BAD", "BLOWING", "BRIGHT", "CONDITION", "CONDITIONS", "DENSE", "DULL", "FAIRLY", "FALLING", "GRAY", "GREY", "HARD", "HEAVY", "HIGH", "IN", "IS", "IT", "LIGHT", "LIKE", "LOW", "MILD", "MODERATE",
        "MOSTLY", "OF", "OUT", "OUTSIDE", "PARTLY", "PATCHES", "PATCHY", "QUITE", "SEVERE", "SKIES", "SKY", "SLIGHT", "SOME", "STEADY", "STRONG", "THE", "THICK", "VERY", "WAS", "WEATHER", "WITH",
    ),
    "crash_month": ("BEGINNING", "EARLY", "END", "IN", "LATE", "MID", "MIDDLE", "MONTH", "OF", "THE"),
}

# Words that together speak for one canonical value.
WORD_PAIRS = {
    "weather_condition": {"FREEZING RAIN": (("FREEZING", "RAIN"), ("FREEZING", "DRIZZLE"), ("ICY", "RAIN"), ("ICY", "DRIZZLE"))},
}

# Roman numbers of the months.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
