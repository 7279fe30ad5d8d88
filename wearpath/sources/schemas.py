"""Column sets and domains of the input files."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, sampling rates, domains and codes of the published files.
ENGINE_COLUMNS = ("unit_id", "cycle", *[f"operational_setting_{i}" for i in range(1, 4)], *[f"sensor_{i}" for i in range(1, 22)])
BATTERY_COLUMNS = ("type", "start_time", "ambient_temperature", "battery_id", "test_id", "uid", "filename", "Capacity", "Re", "Rct")
SAMPLE_COLUMNS = {
    "charge": ("Voltage_measured", "Current_measured", "Temperature_measured", "Current_charge", "Voltage_charge", "Time"),
    "discharge": ("Voltage_measured", "Current_measured", "Temperature_measured", "Current_load", "Voltage_load", "Time"),
    "impedance": ("Sense_current", "Battery_current", "Current_ratio", "Battery_impedance", "Rectified_Impedance"),
}
SENSOR_HZ = {"PS1": 100, "PS2": 100, "PS3": 100, "PS4": 100, "PS5": 100, "PS6": 100, "EPS1": 100, "FS1": 10, "FS2": 10,
             "TS1": 1, "TS2": 1, "TS3": 1, "TS4": 1, "VS1": 1, "CE": 1, "CP": 1, "SE": 1}
CYCLE_SECONDS = 60
PROFILE_DOMAINS = {
    "cooler_condition_percent": (3, 20, 100), "valve_condition_percent": (73, 80, 90, 100), "pump_leakage_severity": (0, 1, 2),
    "accumulator_pressure_bar": (90, 100, 115, 130), "stable_flag": (0, 1),
}
FUEL_CHANNELS = ("FTL", "CTL", "FTF", "FTV_S", "CLF", "CLV_S", "FTT", "CRTT")
FUEL_CODES = {"normal": 0, "one": 1, "two": 2, "three": 3, "four": 4}
LANDING_COLUMNS = ("RunID", "Max_Deflection", "Max_Velocity", "Settling_Time", "Mass", "K_Stiffness", "B_Damping", "Fault_Code", "RUL")
HISTORY_COMPONENTS = ("engine", "battery", "hydraulic", "landing-gear", "fuel-system")


def _records(fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType.fromDDL(fields))


def request_schema(component: str) -> T.StructType:
    """Schema of one JSON request line of a component."""
    text = {
        "engine": "unit_id long, cycle long, " + ", ".join(f"{c} double" for c in ENGINE_COLUMNS[2:]),
        "battery": "voltage_measured double, current_measured double, temperature_measured double, current_load double, "
                   "voltage_load double, time double",
        "fuel-system": ", ".join(f"{c} double" for c in FUEL_CHANNELS),
    }
    base = T.StructType().add("request_id", T.StringType())
    if component == "engine":
        return base.add("subset", T.StringType()).add("records", _records(text["engine"]))
    if component == "battery":
        return (base.add("battery_id", T.StringType()).add("discharge_cycle", T.LongType())
                .add("ambient_temperature", T.DoubleType()).add("samples", _records(text["battery"])))
    if component == "hydraulic":
        return (base.add("cycle_id", T.LongType()).add("operating_condition_stable", T.BooleanType())
                .add("features", T.MapType(T.StringType(), T.DoubleType())))
    if component == "landing-gear":
        for name in ("max_deflection", "max_velocity", "settling_time", "mass"):
            base = base.add(name, T.DoubleType())
        return base
    if component == "fuel-system":
        return base.add("samples", _records(text["fuel-system"]))
    raise ValueError(f"unknown component {component!r}")
