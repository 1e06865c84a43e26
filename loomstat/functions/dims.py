"""Fixed dimension tables."""

# Topics in order, with display name, theme and whether higher level only.
TOPICS = [
    ("kinematics", "Kinematics", "A", False),
    ("forces-momentum", "Forces and Momentum", "A", False),
    ("work-energy-power", "Work, Energy and Power", "A", False),
    ("rigid-body-mechanics", "Rigid Body Mechanics (HL)", "A", True),
    ("galilean-special-relativity", "Galilean and Special Relativity (HL)", "A", True),
    ("thermal-energy-transfers", "Thermal Energy Transfers", "B", False),
    ("greenhouse-effect", "Greenhouse Effect", "B", False),
    ("gas-laws", "Gas Laws", "B", False),
    ("current-circuits", "Current and Circuits", "B", False),
    ("thermodynamics", "Thermodynamics (HL)", "B", True),
    ("simple-harmonic-motion", "Simple Harmonic Motion", "C", False),
    ("wave-model", "Wave Model", "C", False),
    ("wave-phenomena", "Wave Phenomena", "C", False),
    ("standing-waves-resonance", "Standing Waves and Resonance", "C", False),
    ("doppler-effect", "Doppler Effect", "C", False),
    ("gravitational-fields", "Gravitational Fields", "D", False),
    ("electric-magnetic-fields", "Electric and Magnetic Fields", "D", False),
    ("motion-electromagnetic-fields", "Motion in Electromagnetic Fields", "D", False),
    ("induction", "Induction (HL)", "D", True),
    ("structure-atom", "Structure of the Atom", "E", False),
    ("radioactive-decay", "Radioactive Decay", "E", False),
    ("fission", "Fission", "E", False),
    ("fusion-stars", "Fusion and Stars", "E", False),
    ("quantum-physics", "Quantum Physics (HL)", "E", True),
    ("relativity", "Relativity (Option A)", "O", False),
    ("engineering-physics", "Engineering Physics (Option B)", "O", False),
    ("imaging", "Imaging (Option C)", "O", False),
    ("astrophysics", "Astrophysics (Option D)", "O", False),
    ("particle-physics", "Particle Physics (Option E)", "O", False),
]
# Themes.
CATEGORIES = [
    ("A", "Space, time and motion"),
    ("B", "Particulate nature of matter"),
    ("C", "Wave behaviour"),
    ("D", "Fields"),
    ("E", "Nuclear and quantum physics"),
]
# Error types in order.
ERROR_TYPES = [
    "llama_failure",
    "openrouter_failure",
    "openrouter_timeout",
    "openrouter_api_error",
    "openrouter_network_error",
    "validation_failure",
    "api_limit",
    "configuration_error",
]
# Profile, api, requests a minute and a day, tokens a minute and a day, cost a token, cost a day.
LIMITS = [
    ("default", "openrouter", 60, 1000, 32000, 1000000, "0", "0"),
    ("default", "huggingface", 30, 500, 10000, 100000, "0.0000002", "2.00"),
    ("development", "openrouter", 5, 100, 5000, 50000, "0", "0"),
    ("development", "huggingface", 5, 50, 2000, 20000, "0.0000002", "0.50"),
    ("production", "openrouter", 100, 5000, 50000, 5000000, "0", "0"),
    ("production", "huggingface", 60, 2000, 20000, 500000, "0.0000002", "10.00"),
    ("testing", "openrouter", 5, 20, 1000, 5000, "0", "0"),
    ("testing", "huggingface", 3, 10, 500, 2000, "0.0000002", "0.05"),
]
# Ours: prices of a token that the usage records of the test tables are valued at.
METERED = [("metered", "openrouter", 5, 50, 1000, 10000, "0.0000010", "0.10"), ("metered", "huggingface", 3, 20, 500, 5000, "0.0000002", "0.05")]
# Advice by error type, in order.
RECOVERY = {
    "llama_failure": [
        "Check Hugging Face API key and model availability",
        "Verify model ID is correct",
        "Try a different topic or difficulty level",
        "Check network connectivity",
    ],
    "gemini_failure": [
        "Check Gemini API key and quota",
        "Verify API endpoint is accessible",
        "Try disabling refinement temporarily",
        "Check prompt format and length",
    ],
    "validation_failure": [
        "Review question format requirements",
        "Check if topic is supported",
        "Verify model outputs are complete",
        "Consider adjusting validation thresholds",
    ],
    "api_limit": ["Wait for quota reset", "Upgrade API plan if needed", "Implement request queuing", "Use fallback questions temporarily"],
}
RECOVERY_DEFAULT = ["Check system logs for more details", "Try again in a few minutes", "Contact technical support if issue persists"]


def values(rows) -> str:
    """Rows as an SQL VALUES list."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# --- fixed values of the text rules: they must equal the reference's ------------------------------------------
# What a topic is about.
TOPIC_CONTEXTS = {
    "kinematics": "Focus on displacement, velocity, acceleration, equations of motion, and graphical analysis of motion.",
    "forces-momentum": "Include Newton's laws, force analysis, momentum conservation, impulse, and collision problems.",
    "work-energy-power": "Cover work done by forces, kinetic and potential energy, conservation of energy, and power calculations.",
    "rigid-body-mechanics": "Advanced mechanics including rotational motion, torque, angular momentum, and moment of inertia.",
    "galilean-special-relativity": "Galilean transformations, special relativity principles, time dilation, and length contraction.",
    "thermal-energy-transfers": "Heat transfer mechanisms, thermal conductivity, specific heat capacity, and phase changes.",
    "greenhouse-effect": "Radiation balance, greenhouse gases, albedo, and climate change physics.",
    "gas-laws": "Ideal gas law, kinetic theory, pressure-volume relationships, and gas behavior.",
    "current-circuits": "Electric current, resistance, Ohm's law, circuit analysis, and electrical power.",
    "thermodynamics": "Laws of thermodynamics, heat engines, entropy, and thermodynamic cycles.",
    "simple-harmonic-motion": "Oscillatory motion, period, frequency, amplitude, and energy in SHM.",
    "wave-model": "Wave properties, wave equation, wavelength, frequency, and wave speed.",
    "wave-phenomena": "Reflection, refraction, diffraction, interference, and polarization of waves.",
    "standing-waves-resonance": "Stationary waves, nodes, antinodes, resonance, and wave superposition.",
    "doppler-effect": "Frequency shifts due to relative motion between source and observer.",
    "gravitational-fields": "Gravitational field strength, potential, orbital motion, and Kepler's laws.",
    "electric-magnetic-fields": "Electric field strength, potential, magnetic field effects, and field interactions.",
    "motion-electromagnetic-fields": "Charged particle motion in electric and magnetic fields, and electromagnetic forces.",
    "induction": "Electromagnetic induction, Faraday's law, Lenz's law, and induced EMF.",
    "structure-atom": "Atomic models, electron energy levels, emission and absorption spectra.",
    "radioactive-decay": "Radioactive decay processes, half-life, decay constants, and nuclear stability.",
    "fission": "Nuclear fission process, chain reactions, and fission energy calculations.",
    "fusion-stars": "Nuclear fusion, stellar nucleosynthesis, and energy production in stars.",
    "quantum-physics": "Quantum mechanics principles, wave-particle duality, and quantum phenomena.",
    "relativity": "Special and general relativity, spacetime, relativistic effects, and cosmological applications.",
    "engineering-physics": "Applied physics in engineering contexts, materials science, and technological applications.",
    "imaging": "Medical and scientific imaging techniques, optics, and image formation principles.",
    "astrophysics": "Stellar physics, cosmology, galactic structures, and astronomical phenomena.",
    "particle-physics": "Fundamental particles, particle interactions, accelerators, and the Standard Model.",
}
# Words that say nothing.
COMMON_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should"
).split()
# Words that tell higher and standard level.
HL_WORDS = "derive explain analyze evaluate compare contrast discuss justify predict suggest outline complex advanced detailed comprehensive".split()
SL_WORDS = "calculate determine find state identify list define describe simple basic straightforward".split()
# Command terms, casual terms, words of concepts, of the real world, constants and their values.
COMMAND_TERMS = "determine calculate state outline explain discuss suggest predict estimate identify describe".split()
CASUAL_TERMS = ["find out", "figure out", "work out", "get"]
CONCEPT_WORDS = ["because", "therefore", "however", "although", "since", "due to", "relationship", "principle", "theory", "law", "effect"]
REAL_WORLD = ["satellite", "car", "building", "power plant", "medical", "technology", "environment", "energy", "climate", "space", "communication"]
CONSTANTS = ["speed of light", "planck constant", "avogadro constant", "gravitational constant", "elementary charge", "mass of electron"]
CONSTANT_VALUES = ["3.00 × 10⁸", "6.63 × 10⁻³⁴", "6.02 × 10²³", "9.81"]
CONNECTIONS = {
    "Energy": ["energy", "work", "power", "joule", "watt"],
    "Forces": ["force", "newton", "acceleration", "mass"],
    "Waves": ["wave", "frequency", "wavelength", "amplitude"],
    "Electricity": ["current", "voltage", "resistance", "circuit"],
    "Fields": ["field", "gravitational", "electric", "magnetic"],
}
# Possible values by unit (least, most), usual values and formulas by topic.
UNIT_LIMITS = {"K": (0.0, None), "°C": (-273.15, None), "m/s": (None, 299792458.0), "kg": (0.0, None), "Hz": (0.0, None)}
USUAL_RANGES = {"kinematics": (1e-3, 1e8), "current-circuits": (1e-6, 1e6), "forces-momentum": (1e-6, 1e12)}
FORMULAS = {
    "kinematics": ["v = u + at", "s = ut + ½at²", "v² = u² + 2as"],
    "forces-momentum": ["F = ma", "p = mv", "F = Δp/Δt"],
    "work-energy-power": ["W = Fd", "KE = ½mv²", "PE = mgh", "P = W/t"],
    "current-circuits": ["V = IR", "P = VI", "P = I²R", "P = V²/R"],
}
# Names of topics in older requests.
LEGACY_TOPICS = {
    "mechanics": "kinematics",
    "waves": "wave-model",
    "electricity & magnetism": "current-circuits",
    "electricity": "current-circuits",
    "magnetism": "electric-magnetic-fields",
    "thermal": "thermal-energy-transfers",
    "energy": "work-energy-power",
    "forces": "forces-momentum",
}
# Questions that stand in where none can be made (topic, number, text, options, answer).
FALLBACKS = [
    ("kinematics", 0, "A car travels 100 m in 10 s at constant velocity. What is its speed?", ["A) 5 m/s", "B) 10 m/s", "C) 15 m/s", "D) 20 m/s"], "B"),
    ("kinematics", 1, "An object accelerates from rest at 2 m/s² for 5 s. What is its final velocity?", ["A) 5 m/s", "B) 10 m/s", "C) 15 m/s", "D) 20 m/s"], "B"),
    ("forces-momentum", 0, "What force is needed to accelerate a 10 kg mass at 2 m/s²?", ["A) 5 N", "B) 10 N", "C) 20 N", "D) 40 N"], "C"),
    ("work-energy-power", 0, "How much work is done lifting a 5 kg object 2 m high? (g = 10 m/s²)", ["A) 50 J", "B) 100 J", "C) 150 J", "D) 200 J"], "B"),
    ("current-circuits", 0, "What current flows through a 10 Ω resistor connected to a 12 V battery?", ["A) 0.8 A", "B) 1.2 A", "C) 2.0 A", "D) 2.4 A"], "B"),
]
FALLBACK_OPTIONS = ["A) Option A", "B) Option B", "C) Option C", "D) Option D"]
# Options that stand in until a record is refined.
PLACEHOLDER_OPTIONS = ["A) 10 m/s", "B) 20 m/s", "C) 5 m/s", "D) 15 m/s"]
# Estimated cost of an operation; settings by environment and by model.
OPERATION_COSTS = [("questionGeneration", "0.0001"), ("batchGeneration", "0.0008"), ("validation", "0.00002")]
ENVIRONMENTS = [("development", 2, 20000, 0.8, 500), ("production", 3, 60000, 0.7, 500), ("testing", 1, 10000, 0.5, 200)]
MODEL_SETTINGS = [("ib-physics-question-generator", 0.7, 500, 0.9), ("ib-physics-question-generator-v2", 0.6, 600, 0.85)]
