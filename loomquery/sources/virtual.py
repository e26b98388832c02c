"""Small relations that need no file."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.errors import NotAllowed, QueryError

PLANET_SCHEMA = (
    "id long, name string, mass double, diameter long, density long, gravity decimal(3,1), escapeVelocity double, rotationPeriod double, lengthOfDay double, distanceFromSun double, perihelion double, aphelion double, "
    "orbitalPeriod double, orbitalVelocity double, orbitalInclination double, orbitalEccentricity double, obliquityToOrbit double, meanTemperature long, surfacePressure double, numberOfMoons long"
)
#: The public planetary fact sheet, in the order of the schema.
PLANETS = [
    (1, "Mercury", 0.33, 4879, 5427, "3.7", 4.3, 1407.6, 4222.6, 57.9, 46.0, 69.8, 88.0, 47.4, 7.0, 0.205, 0.03, 167, 0.0, 0),
    (2, "Venus", 4.87, 12104, 5243, "8.9", 10.4, -5832.5, 2802.0, 108.2, 107.5, 108.9, 224.7, 35.0, 3.4, 0.007, 177.4, 464, 92.0, 0),
    (3, "Earth", 5.97, 12756, 5514, "9.8", 11.2, 23.9, 24.0, 149.6, 147.1, 152.1, 365.2, 29.8, 0.0, 0.017, 23.4, 15, 1.0, 1),
    (4, "Mars", 0.642, 6792, 3933, "3.7", 5.0, 24.6, 24.7, 227.9, 206.6, 249.2, 687.0, 24.1, 1.9, 0.094, 25.2, -63, 0.001, 2),
    (5, "Jupiter", 1898.0, 142984, 1326, "23.1", 59.5, 9.9, 9.9, 778.6, 740.5, 816.6, 4331.0, 13.1, 1.3, 0.049, 3.1, -108, None, 79),
    (6, "Saturn", 568.0, 120536, 687, "9.0", 35.5, 10.7, 10.7, 1433.5, 1352.6, 1514.5, 10747.0, 9.7, 2.5, 0.057, 26.7, -139, None, 82),
    (7, "Uranus", 86.8, 51118, 1271, "8.7", 21.3, -17.2, 17.2, 2872.5, 2741.3, 3003.6, 30589.0, 6.8, 0.8, 0.046, 97.8, -197, None, 27),
    (8, "Neptune", 102.0, 49528, 1638, "11.0", 23.5, 16.1, 16.1, 4495.1, 4444.5, 4545.7, 59800.0, 5.4, 1.8, 0.011, 28.3, -201, None, 14),
    (9, "Pluto", 0.0146, 2370, 2095, "0.7", 1.3, -153.3, 153.3, 5906.4, 4436.8, 7375.9, 90560.0, 4.7, 17.2, 0.244, 122.5, -225, 0.00001, 5),
]
#: The day each was found, for reads as of an earlier day.
FOUND = {"Uranus": dt.date(1781, 4, 26), "Neptune": dt.date(1846, 11, 13), "Pluto": dt.date(1930, 3, 13)}


def planets(spark: SparkSession, until: dt.date | None = None) -> DataFrame:
    """The planets that were known on a day."""
    rows = [(*r[:5], Decimal(r[5]), *r[6:]) for r in PLANETS if until is None or until >= FOUND.get(r[1], dt.date.min)]
    return spark.createDataFrame(rows, PLANET_SCHEMA)


def no_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0,)], "`$column` long")


def stop_words(spark: SparkSession) -> DataFrame:
    from loomquery.functions.library import STOP

    return spark.createDataFrame([(w,) for w in STOP], "value string")


#: Other names of columns, by relation.
ALIASES = {
    "$planets": {
        "escape_velocity": "escapeVelocity", "rotation_period": "rotationPeriod", "length_of_day": "lengthOfDay", "distance_from_sun": "distanceFromSun", "orbital_period": "orbitalPeriod", "oribtal_velocity": "orbitalVelocity", "orbital_velocity": "orbitalVelocity",
        "oribtial_inclination": "orbitalInclination", "orbital_inclination": "orbitalInclination", "orbital_eccentricity": "orbitalEccentricity", "obliquity_to_orbit": "obliquityToOrbit", "mean_temperature": "meanTemperature", "surface_pressure": "surfacePressure", "number_of_moons": "numberOfMoons",
    },
    "$satellites": {"planet_id": "planetId"},
    "$missions": {"launched_at": "Lauched_at"},
}
#: Sample relations that are read from a folder, and their columns.
SAMPLES = {
    "$satellites": "id long, planetId long, name string, gm double, radius double, density double, magnitude double, albedo double",
    "$astronauts": "name string, year long, group long, status string, birth_date date, birth_place string, gender string, alma_mater array<string>, undergraduate_major string, graduate_major string, military_rank string, military_branch string, space_flights long, space_flight_hours long, space_walks long, space_walks_hours long, missions array<string>, death_date date, death_mission string",
    "$missions": "Company string, Location string, Price double, Lauched_at timestamp_ntz, Rocket string, Rocket_Status string, Mission string, Mission_Status string",
}


def sample(df: DataFrame, name: str) -> DataFrame:
    """A sample relation's file with the columns and types it is known for; columns it lacks are null."""
    have = {c.lower(): c for c in df.columns}
    columns = [c.split(" ", 1) for c in SAMPLES[name].split(", ")]
    return df.select(*((F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns))


#: Settings that clients of this kind ask for, all set by the server.
SYSTEM: dict[str, object] = {
    "auto_increment_increment": 1, "autocommit": True, "character_set_client": "utf8mb4", "character_set_connection": "utf8mb4", "character_set_database": "utf8mb4", "character_set_results": "utf8mb4", "character_set_server": "utf8mb4",
    "collation_connection": "utf8mb4_general_ci", "collation_database": "utf8mb4_general_ci", "collation_server": "utf8mb4_general_ci", "event_scheduler": "OFF", "interactive_timeout": 28800, "lower_case_table_names": 0, "max_allowed_packet": 67108864, "max_execution_time": 0,
    "net_buffer_length": 16384, "net_write_timeout": 28800, "performance_schema": False, "sql_auto_is_null": False, "sql_mode": "ANSI", "sql_select_limit": None, "system_time_zone": "UTC", "time_zone": "UTC", "transaction_isolation": "READ-COMMITTED", "transaction_read_only": False, "wait_timeout": 28800,
}


def value_of(values: dict[str, object], name: str, roles: tuple[str, ...]) -> object:
    """A variable's value: the session's own, or the system's; user_memberships are its roles."""
    if name in values:
        return values[name]
    if name == "user_memberships":
        return list(roles)
    if name in SYSTEM:
        return SYSTEM[name]
    raise QueryError(f"no variable {name}")


def checked(name: str, value: object) -> object:
    """value, if a session may set the variable."""
    if name in SYSTEM or name == "user_memberships":
        raise NotAllowed(f"{name} is set by the server")
    return value


def variables(spark: SparkSession, values: dict[str, object], roles: tuple[str, ...] | None) -> DataFrame:
    """Variables with their owners; the system's too, unless roles are None."""
    kinds = {"str": "VARCHAR", "int": "INTEGER", "float": "DOUBLE", "bool": "BOOLEAN", "list": "ARRAY", "NoneType": "NULL"}
    rows = [(k, v, "USER") for k, v in values.items()]
    if roles is not None:
        rows += [(k, v, "SERVER") for k, v in SYSTEM.items()] + [("user_memberships", list(roles), "INTERNAL")]
    return spark.createDataFrame([(k, str(v), kinds.get(type(v).__name__, "VARCHAR"), owner, "UNRESTRICTED") for k, v, owner in sorted(rows, key=lambda r: r[0])], "name string, value string, type string, owner string, visibility string")
