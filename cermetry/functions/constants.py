"""Physical constants, unit tables, word lists and thresholds.

Everything in this module is data that must have exactly these values for
results to be right.  Logic lives elsewhere.
"""

# --- fixed values: element properties --------------------------------------
# symbol: (atomic number, group, period, molar mass g/mol, density g/cm3,
#          metallic radius A, valence electrons, Pauling electronegativity,
#          melting point K, shear modulus GPa, lattice constant A,
#          thermal expansion um/m/K, wetting index on WC)
ELEMENT_FIELDS = (
    "number", "grp", "period", "mass", "rho", "r", "vec", "chi",
    "tm", "shear", "lattice", "cte", "wet",
)
ELEMENTS = {
    "Al": (13, 13, 3, 26.9815, 2.7, 1.43, 3, 1.61, 933.47, 26, 4.05, 23.1, 5),
    "Co": (27, 9, 4, 58.9331, 8.9, 1.25, 9, 1.88, 1768.15, 75, 3.54, 13.0, 10),
    "Cr": (24, 6, 4, 51.9961, 7.19, 1.28, 6, 1.66, 2180.0, 115, 2.91, 4.9, 7),
    "Cu": (29, 11, 4, 63.546, 8.96, 1.28, 11, 1.9, 1357.77, 48, 3.61, 16.5, 2),
    "Fe": (26, 8, 4, 55.845, 7.87, 1.26, 8, 1.83, 1811.15, 82, 2.87, 11.8, 10),
    "Mn": (25, 7, 4, 54.938, 7.21, 1.27, 7, 1.55, 1519.15, 80, 8.91, 21.7, 8),
    "Ni": (28, 10, 4, 58.6934, 8.9, 1.24, 10, 1.91, 1728.15, 76, 3.52, 13.4, 10),
    "Ti": (22, 4, 4, 47.867, 4.54, 1.47, 4, 1.54, 1941.15, 45, 2.95, 8.6, 9),
    "V": (23, 5, 4, 50.9415, 6.11, 1.34, 5, 1.63, 2183.15, 47, 3.03, 8.4, 9),
    "Zr": (40, 4, 5, 91.224, 6.52, 1.6, 4, 1.33, 2128.15, 34, 3.23, 5.7, 9),
    "Nb": (41, 5, 5, 92.906, 8.57, 1.46, 5, 1.6, 2750.15, 38, 3.3, 7.3, 9),
    "Mo": (42, 6, 5, 95.95, 10.28, 1.39, 6, 2.16, 2896.15, 120, 3.15, 4.8, 8),
    "Hf": (72, 4, 6, 178.49, 13.31, 1.59, 4, 1.3, 2506.15, 30, 3.19, 5.9, 9),
    "Ta": (73, 5, 6, 180.948, 16.69, 1.46, 5, 1.5, 3290.15, 69, 3.3, 6.3, 9),
    "W": (74, 6, 6, 183.84, 19.3, 1.39, 6, 2.36, 3695.15, 160, 3.16, 4.5, 8),
    "C": (6, 14, 2, 12.011, 2.26, 0.77, 4, 2.55, 3823.15, 480, 3.57, 5.2, 0),
    "N": (7, 15, 2, 14.007, 0.00125, 0.75, 5, 3.04, 63.15, 0, 0, 0, 0),
    "Si": (14, 14, 3, 28.085, 2.33, 1.18, 4, 1.9, 1687.15, 64, 5.43, 2.6, 4),
    "B": (5, 13, 2, 10.81, 2.34, 0.9, 3, 2.04, 2349.15, 180, 8.73, 6.0, 4),
}
# --- fixed values: bulk and Young's moduli (GPa), resistivities (1e-8 Ohm m) --
# Handbook values that only some elements have; an
# absent element is skipped by the weighted means that use them.
BULK_MODULUS = {
    "Al": 76, "Co": 180, "Cr": 160, "Cu": 140, "Fe": 170, "Mn": 120, "Ni": 180,
    "Ti": 110, "V": 160, "Nb": 170, "Mo": 230, "Hf": 110, "Ta": 200, "W": 310,
    "C": 33, "Si": 100, "B": 320,
}
YOUNGS_MODULUS = {
    "Al": 70, "Co": 209, "Cr": 279, "Cu": 130, "Fe": 211, "Mn": 198, "Ni": 200,
    "Ti": 116, "V": 128, "Zr": 68, "Nb": 105, "Mo": 329, "Hf": 78, "Ta": 186,
    "W": 411, "Si": 47,
}
RESISTIVITY = {
    "Al": 2.7, "Co": 6.0, "Cr": 12.7, "Cu": 1.72, "Fe": 10.0, "Mn": 144.0,
    "Ni": 7.2, "Ti": 40.0, "V": 20.0, "Zr": 43.3, "Nb": 15.2, "Mo": 5.5,
    "Hf": 34.0, "Ta": 13.5, "W": 5.4,
}

# --- fixed values: hardness models (exponents, factors), ductility limit ----
CHEN_EXPONENT, CHEN_OFFSET = 0.585, 3
TIAN_FACTOR, TIAN_RATIO_EXPONENT, TIAN_SHEAR_EXPONENT = 0.92, 1.137, 0.708
PUGH_LIMIT = 1.75
# --- fixed values: grades, lower limits of the levels above the first -------
GRADES = ("Low", "Medium", "High", "Very High")
HARDNESS_LIMITS = (800, 1200, 1600)
TOUGHNESS_LIMITS = (10, 15, 20)

# --- fixed values: binary mixing enthalpies, kJ/mol, key in sorted order ----
ENTHALPY = {
    "Al-Co": -19, "Al-Cr": -10, "Al-Cu": -1, "Al-Fe": -11, "Al-Ni": -22,
    "Al-Ti": -30, "Co-Cr": -4, "Co-Cu": 6, "Co-Fe": -1, "Co-Ni": 0,
    "Co-Ti": -28, "Cr-Fe": -1, "Cr-Ni": -7, "Cr-Ti": -7, "Cu-Fe": 13,
    "Cu-Ni": 4, "Cu-Ti": -9, "Fe-Ni": -2, "Fe-Ti": -17, "Ni-Ti": -35,
    "Al-Mn": -19, "Al-V": -16, "Al-Nb": -18, "Al-Mo": -5, "Al-Ta": -19,
    "Al-W": -2, "Al-Zr": -44, "Al-Hf": -39, "Co-Mn": -5, "Co-V": -14,
    "Co-Nb": -25, "Co-Mo": -5, "Co-Ta": -24, "Co-W": -1, "Co-Zr": -41,
    "Co-Hf": -34, "Cr-Mn": 2, "Cr-V": -2, "Cr-Nb": -7, "Cr-Mo": 0,
    "Cr-Ta": -7, "Cr-W": 1, "Cr-Zr": -12, "Cr-Hf": -9, "Cu-Mn": 4,
    "Cu-V": 5, "Cu-Nb": 3, "Cu-Mo": 19, "Cu-Ta": 2, "Cu-W": 23,
    "Cu-Zr": -23, "Cu-Hf": -17, "Fe-Mn": 0, "Fe-V": -7, "Fe-Nb": -16,
    "Fe-Mo": -2, "Fe-Ta": -15, "Fe-W": 0, "Fe-Zr": -25, "Fe-Hf": -21,
    "Mn-Ni": -8, "Ni-V": -18, "Nb-Ni": -30, "Mo-Ni": -7, "Ni-Ta": -29,
    "Ni-W": -3, "Ni-Zr": -49, "Hf-Ni": -42, "Mn-Ti": -8, "Ti-V": -2,
    "Nb-Ti": 2, "Mo-Ti": -4, "Ta-Ti": 1, "Ti-W": -6, "Ti-Zr": 0,
    "Hf-Ti": 0, "Mn-V": -5, "Mn-Nb": -4, "Mn-Mo": 5, "Mn-Ta": -3,
    "Mn-W": 7, "Mn-Zr": -24, "Hf-Mn": -19, "Nb-V": 1, "Mo-V": -6,
    "Ta-V": 1, "V-W": -8, "V-Zr": -4, "Hf-V": -2, "Mo-Nb": -6,
    "Nb-Ta": 0, "Nb-W": -8, "Nb-Zr": 4, "Hf-Nb": 4, "Mo-Ta": -5,
    "Mo-W": 0, "Mo-Zr": -6, "Hf-Mo": -4, "Ta-W": -4, "Ta-Zr": 3,
    "Hf-Ta": 3, "W-Zr": -9, "Hf-W": -6, "Hf-Zr": 0,
}

# --- fixed values: compounds ------------------------------------------------
# formula: (formation enthalpy kJ/mol, density g/cm3, structure, lattice a,
#           lattice c or None, nearest-neighbour distance)
COMPOUND_FIELDS = ("enthalpy", "density", "structure", "lattice_a", "lattice_c", "neighbor")
COMPOUNDS = {
    "WC": (-40.0, 15.63, "hexagonal", 2.906, 2.837, 2.906),
    "TiC": (-184.0, 4.93, "fcc", 4.328, None, 3.061),
    "TaC": (-143.0, 14.3, "fcc", 4.456, None, 3.151),
    "NbC": (-138.0, 7.6, "fcc", 4.47, None, 3.161),
    "VC": (-101.0, 5.77, "fcc", 4.166, None, 2.946),
    "HfC": (-209.0, 12.2, "fcc", 4.64, None, 3.281),
    "ZrC": (-197.0, 6.73, "fcc", 4.698, None, 3.322),
    "Cr3C2": (-89.0, 6.68, "orthorhombic", 5.53, 11.48, 2.7),
    "Mo2C": (-53.0, 9.18, "hexagonal", 3.002, 4.724, 3.002),
    "AlN": (-318.0, 3.26, "hexagonal", 3.111, 4.981, 3.111),
    "TiN": (-338.0, 5.22, "fcc", 4.242, None, 3.0),
    "SiC": (-65.0, 3.21, "hexagonal", 3.086, 10.053, 3.086),
    "Al2O3": (-1675.7, 3.95, "hexagonal", 4.759, 12.991, 4.759),
    "TiO2": (-944.0, 4.23, "tetragonal", 4.593, 2.959, 4.593),
    "Si3N4": (-744.8, 3.17, "hexagonal", 7.753, 5.618, 7.753),
    "ZrO2": (-1080.0, 5.68, "monoclinic", 5.145, 5.317, 5.145),
    "MgO": (-601.6, 3.58, "fcc", 4.212, None, 2.978),
    "BN": (-250.9, 2.1, "hexagonal", 2.504, 6.661, 2.504),
}

# --- fixed values: densities used by the volume/weight conversions ----------
METAL_DENSITY = {
    "Co": 8.90, "Ni": 8.91, "Fe": 7.87, "Cr": 7.19, "Mn": 7.21, "Cu": 8.96,
    "Al": 2.70, "Ti": 4.51, "V": 6.00, "Mo": 10.28, "W": 19.25, "Nb": 8.57,
    "Ta": 16.69, "Zr": 6.52, "Hf": 13.31, "Re": 21.02, "Ru": 12.45,
    "Rh": 12.41, "Pd": 12.02, "Ir": 22.56, "Pt": 21.45, "Au": 19.32, "Ag": 10.49,
}
DEFAULT_METAL_DENSITY = 8.0
DEFAULT_CERAMIC_DENSITY = 15.0
QUICK_DENSITY = {
    "WC": 15.6, "TiC": 4.93, "TiCN": 5.2, "TiN": 5.4,
    "Co": 8.9, "Ni": 8.9, "Fe": 7.87, "Cr": 7.19,
}
QUICK_METAL_DENSITY = 8.5

# --- fixed values: phase and metal word lists -------------------------------
CERAMIC_PHASES = (
    "WC", "TiC", "TiN", "TiCN", "TaC", "NbC", "VC", "Cr3C2", "Mo2C", "W2C",
    "ZrC", "HfC", "SiC", "Al2O3", "ZrO2", "TiO2",
)
BINDER_METALS = (
    "Co", "Ni", "Fe", "Cr", "Mn", "Cu", "Al", "Ti", "V", "Mo", "W", "Nb", "Ta",
    "Zr", "Hf", "Re", "Ru", "Rh", "Pd", "Ir", "Pt", "Au", "Ag", "Mg", "Zn", "Si",
)
HARD_PHASES = (
    "WC", "TiCN", "TiC", "TiN", "TaC", "NbC", "VC", "Mo2C", "Cr3C2", "ZrC",
    "HfC", "MoC", "ZrO2", "Al2O3", "SiC", "B4C", "TiB2",
)
SHEET_METALS = (
    "Co", "Ni", "Fe", "Cr", "Mo", "W", "Ti", "Al", "Nb", "Ta", "Re", "Mn", "Cu",
    "V", "Zr", "Hf",
)
HEA_SYMBOLS = (
    "Co", "Ni", "Fe", "Cr", "Mo", "W", "Ti", "V", "Nb", "Ta", "Zr", "Hf", "Al",
    "Cu", "Mn", "Re", "Ru",
)
TRANSITION_METALS = (
    "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zr", "Nb", "Mo", "Tc", "Ru",
    "Rh", "Pd", "Ag", "Hf", "Ta", "W", "Re", "Os", "Ir", "Pt", "Au",
)
INTERSTITIALS = ("C", "N", "B", "O")
VOLUME_BINDERS = ("Co", "Ni", "Fe", "Al", "Cu", "Mn")
ACTIVE_ELEMENTS = ("Ti", "Zr", "Hf", "V", "Nb", "Ta", "Cr", "Mo", "W", "Mn")

# --- fixed values: tungsten carbide and gas constant ------------------------
R_GAS = 8.314
WC = {"a": 2.906, "c": 2.837, "shear": 283.0, "cte": 5.2, "h0": 1600.0, "hall_petch": 600.0}

# --- fixed values: interface parameters, (lattice a, neighbour distance) ----
SQRT2 = 2 ** 0.5
CERAMIC_INTERFACE = {
    "WC": (2.906, 2.906),
    "TiC": (4.328, 4.328 / SQRT2),
    "TiN": (4.242, 4.242 / SQRT2),
    "Ti(C,N)": (4.285, 4.285 / SQRT2),
    "TiCN": (4.285, 4.285 / SQRT2),
    "VC": (4.166, 4.166 / SQRT2),
    "NbC": (4.470, 4.470 / SQRT2),
    "Cr3C2": (5.53, 2.7),
}
MODEL_LATTICE = {"WC": 2.906, "TiC": 4.32, "TiN": 4.24, "VC": 4.16, "NbC": 4.47, "TaC": 4.45}
VEGARD_RADII = {
    "Co": 1.25, "Cr": 1.28, "Fe": 1.26, "Ni": 1.24, "Cu": 1.28, "Al": 1.43,
    "Ti": 1.47, "V": 1.34, "Mn": 1.27, "Mo": 1.39, "W": 1.39, "Nb": 1.46,
    "Ta": 1.46, "Zr": 1.60, "Hf": 1.59, "C": 0.77, "N": 0.75, "O": 0.73, "Si": 1.17,
}
VEGARD_DEFAULT_RADIUS = 1.3

# --- fixed values: ingest vocabulary ----------------------------------------
MISSING_TOKENS = ("-", "", "nan", "NaN", "N/A", "n/a", "NA", "null", "NULL", "None", "#N/A")
COLUMN_ALIASES = {
    "binder_composition": ["binder_comp", "binder", "composition", "comp", "formula", "alloy_composition"],
    "wc_content": ["wc%", "wc_pct", "wc_percent", "tungsten_carbide"],
    "co_content": ["co%", "co_pct", "co_percent", "cobalt"],
    "ni_content": ["ni%", "ni_pct", "ni_percent", "nickel"],
    "fe_content": ["fe%", "fe_pct", "fe_percent", "iron"],
    "cr_content": ["cr%", "cr_pct", "cr_percent", "chromium"],
    "sinter_temp": ["temperature", "temp", "t_sinter", "sintering_temp", "process_temp", "sinter_temperature"],
    "sinter_time": ["time", "sintering_time", "t_time", "holding_time", "process_time"],
    "grain_size": ["grain_size_um", "grain_size_micron", "d_grain", "particle_size", "wc_grain_size"],
    "pressure": ["sintering_pressure", "p_sinter", "applied_pressure"],
    "hardness": ["hv", "vickers_hardness", "hardness_hv", "hardness_value"],
    "toughness": ["fracture_toughness", "k_ic", "kic", "toughness_mpa_m"],
    "trs": ["transverse_rupture_strength", "flexural_strength", "bend_strength"],
    "density": ["relative_density", "bulk_density", "rho"],
    "vec": ["valence_electron_concentration", "average_vec"],
    "delta": ["atomic_size_difference", "size_mismatch", "delta_pct"],
    "s_mix": ["mixing_entropy", "entropy", "s_config"],
    "h_mix": ["mixing_enthalpy", "enthalpy", "delta_h_mix"],
    "pred_formation_energy": ["formation_energy_pred", "ef_pred", "pred_ef"],
    "pred_lattice_param": ["lattice_pred", "a_pred", "pred_lattice"],
    "lattice_mismatch_wc": ["lattice_mismatch", "mismatch_wc", "strain"],
    "pred_magnetic_moment": ["magmom_pred", "magnetic_moment_pred", "pred_magmom"],
    "pred_bulk_modulus": ["bulk_modulus_pred", "b_pred", "pred_b"],
    "pred_shear_modulus": ["shear_modulus_pred", "g_pred", "pred_g"],
    "pred_pugh_ratio": ["pugh_ratio_pred", "b_g_ratio_pred", "pred_pugh"],
    "pred_brittleness_index": ["brittleness_pred", "brittleness", "pred_brit"],
}
SHEET_ALIASES = {
    "composition_raw": ["Composition", "comp", "成分", "组成"],
    "group_id": ["Group", "数据来源", "source", "分组"],
    "subgroup": ["Subgroup", "子组", "sub_group"],
    "binder_vol_pct": ["Binder, vol-%", "Binder_Vol_Pct", "粘结相体积分数", "Binder Vol%", "vol%"],
    "binder_wt_pct": ["Binder, wt-%", "Binder_Wt_Pct", "粘结相质量分数", "Binder Wt%", "wt%"],
    "ceramic_type": ["Ceramic_Type", "陶瓷相类型", "Ceramic Type", "ceramic"],
    "binder_composition": ["Binder_Composition", "Binder Composition", "粘结相成分"],
    "sinter_temp_c": ["T, °C", "Sinter_Temp_C", "烧结温度", "Temperature", "Temp", "T"],
    "grain_size_um": ["d, mm", "Grain_Size_um", "晶粒尺寸", "Grain Size", "d"],
    "sinter_method": ["Sintering", "Sintering_Method", "烧结方法", "Sinter Method"],
    "load_kgf": ["Load, kgf", "Load", "测试载荷", "Test Load"],
    "hv": ["HV, kgf/mm2", "HV_kgf_mm2", "硬度", "Hardness", "HV"],
    "kic": ["KIC, MPa·m1/2", "KIC_MPa_m", "断裂韧性", "Fracture Toughness", "KIC"],
    "trs": ["TRS, MPa", "TRS_MPa", "抗弯强度", "Transverse Rupture Strength", "TRS"],
}

# --- fixed values: validation ranges ----------------------------------------
FIELD_RANGES = {
    "hv": (0, 5000), "kic": (0, 50), "trs": (0, 10000), "sinter_temp_c": (0, 3000),
    "grain_size_um": (0.01, 100000), "binder_vol_pct": (0, 100), "binder_wt_pct": (0, 100),
}
COMPOSITION_LIMITS = {"min_share": 0.001, "max_share": 1.0, "min_total": 0.99, "max_total": 1.01, "max_elements": 10}
# name: (hard low, hard high, recommended low, recommended high)
DESIGN_LIMITS = {
    "ceramic_vol_fraction": (0.0, 0.95, 0.4, 0.8),
    "grain_size_um": (0.1, 50.0, 0.5, 5.0),
    "sinter_temp_c": (1000.0, 1800.0, 1350.0, 1550.0),
    "sinter_time_min": (10.0, 600.0, None, None),
}
# metric: (hard low, hard high, typical low, typical high)
PREDICTION_RANGES = {
    "HV": (500.0, 3500.0, 1200.0, 2000.0),
    "KIC": (3.0, 25.0, 8.0, 15.0),
    "pred_formation_energy": (-3.0, 1.0, -1.0, 0.0),
    "pred_lattice_param": (3.0, 4.5, 3.5, 3.7),
    "pred_magnetic_moment": (-5.0, 5.0, -1.0, 1.0),
}
PROXY_DEFAULTS = {
    "pred_formation_energy": -0.5, "pred_lattice_param": 3.6, "pred_magnetic_moment": 0.5,
    "pred_bulk_modulus": 200.0, "pred_shear_modulus": 80.0,
}

# --- fixed values: screening space (element: low, high wt%) ------------------
ELEMENT_SPACE = {
    "Co": (0, 80), "Cr": (0, 30), "Ni": (0, 40), "Fe": (0, 20),
    "W": (0, 10), "Mo": (0, 10), "Ti": (0, 5),
}
