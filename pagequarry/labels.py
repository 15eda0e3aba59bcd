"""The field labels of each content type."""

from __future__ import annotations

DEFAULT_THRESHOLD = 70

# Labels, declared types and thresholds, in declared order.
FIELD_MAPPING = {
    "movies": {
        "title": {
            "labels": ["Title", "Film Title", "Movie", "ဇာတ်ကားအမည်", "Titre du film", "映画タイトル"],
            "type": "string",
            "required": True,
            "confidence_threshold": 70,
        },
        "year": {
            "labels": ["Year", "Release Year", "နှစ်", "ခုနှစ်", "Année de sortie", "年"],
            "type": "integer",
            "format": "yyyy",
            "required": False,
        },
        "director": {
            "labels": ["Director", "Directed By", "Filmmaker", "ဒါရိုက်တာ", "Réalisateur"],
            "type": "string",
            "required": False,
        },
        "genre": {
            "labels": ["Genre", "Category", "Type", "အမျိုးအစား", "ジャンル"],
            "type": "categorical",
            "required": False,
        },
        "duration": {
            "labels": ["Duration", "Running Time", "Runtime", "ချိန်အကြာ", "ကြာချိန်", "Durée"],
            "type": "string",
            "required": False,
        },
        "cast": {
            "labels": ["Cast", "Actors", "Starring", "သရုပ်ဆောင်", "Acteurs"],
            "type": "list",
            "required": False,
        },
    },
    "games": {
        "title": {
            "labels": ["Game Title", "Title", "နာမည်", "Nom du jeu", "ゲームタイトル"],
            "type": "string",
            "required": True,
            "confidence_threshold": 70,
        },
        "developer": {
            "labels": ["Developer", "Game Studio", "တီထွင်သူ", "Développeur", "開発者"],
            "type": "string",
            "required": True,
        },
        "publisher": {
            "labels": ["Publisher", "发行商", "Éditeur", "Publisher Name", "ထုတ်ဝေသူ"],
            "type": "string",
            "required": False,
        },
        "platform": {
            "labels": ["Platform", "Console", "Device", "游戏平台", "Plateforme"],
            "type": "categorical",
            "required": True,
        },
        "genre": {
            "labels": ["Genre", "Game Type", "Game Category", "အမျိုးအစား", "ジャンル"],
            "type": "categorical",
            "required": True,
        },
        "release_date": {
            "labels": ["Release Date", "Launch Date", "ရက်စွဲ", "Date de sortie"],
            "type": "date",
            "format": "yyyy-mm-dd",
            "required": False,
        },
        "modes": {
            "labels": ["Game Modes", "Modes", "Single-player / Multiplayer", "Spielmodi"],
            "type": "list",
            "required": False,
        },
    },
}


def field_mapping(content_type: str = "movies", config: dict | None = None) -> dict[str, dict]:
    """Fields of a content type that have labels; an unknown type is an error."""
    config = FIELD_MAPPING if config is None else config
    if content_type not in config:
        raise ValueError(f"unknown content type {content_type!r}; available: {', '.join(config)}")
    return {f: m for f, m in config[content_type].items() if isinstance(m, dict) and "labels" in m}


def field_names(content_type: str = "movies") -> list[str]:
    return list(field_mapping(content_type))


def labels_for(field: str, content_type: str = "movies") -> list[str]:
    return field_mapping(content_type).get(field, {}).get("labels", [])


def threshold_for(field: str, content_type: str = "movies") -> int:
    return field_mapping(content_type).get(field, {}).get("confidence_threshold", DEFAULT_THRESHOLD)
