from raggedly.functions.names import family_of, plottable
from raggedly.plans import layout as L
from raggedly.plans.spec import CATEGORIES, EventSpec, Treatment

VIEW = "View"


def columns(group, *features):
    return [f"{VIEW}_{group}_{f}" for f in features]


# Groups, columns and sizes of the worked example, and its widths below.
EIGHTEEN_CLASSES = EventSpec.from_config(
    {
        "jets": {
            "cols": columns("JetPuppiAK4", "PT", "Eta", "Phi", "Mass", "BTag", "NCharged", "NNeutrals"),
            "topk": 12, "count": True,
        },
        "electrons": {
            "cols": columns(
                "Electron", "PT", "Eta", "Phi", "Charge", "EhadOverEem", "IsolationVarRhoCorr", "D0", "DZ"
            ),
            "topk": 8, "count": False,
        },
        "muons": {
            "cols": columns("MuonTight", "PT", "Eta", "Phi", "Charge", "IsolationVarRhoCorr", "D0", "DZ"),
            "topk": 8, "count": False,
        },
        "photons": {
            "cols": columns("PhotonTight", "PT", "Eta", "Phi", "EhadOverEem", "IsolationVarRhoCorr"),
            "topk": 8, "count": False,
        },
        "met": {"cols": columns("PUPPIMET", "MET", "Phi"), "topk": None},
    }
)


def test_widths_of_the_worked_example():
    raw = L.raw_layout(EIGHTEEN_CLASSES)
    assert [s.end - s.start for s in raw] == [85, 64, 56, 40, 2]
    assert EIGHTEEN_CLASSES.width == L.width(raw) == 247
    expanded = L.expanded_layout(raw, Treatment())
    assert [s.end - s.start for s in expanded] == [97, 88, 80, 48, 3]
    assert L.width(expanded) == len(L.expanded_slots(raw, Treatment())) == 316
    assert L.summary(raw)["jets"] == {"start": 0, "end": 85, "num_columns": 7}


def test_families():
    assert family_of("V_MET_Phi") == "phi"
    assert family_of("V_JetPuppiAK8_BTag") == "puppibtag"
    assert family_of("V_JetAK4_BTagPhys") == "btag"
    assert family_of("V_PrimaryVertex_Z") == "vertexcoord"
    assert family_of("V_PrimaryVertex_W") == "other"
    assert len(CATEGORIES["pid"]) == 21 and list(CATEGORIES["pid"]) == sorted(CATEGORIES["pid"])


def test_expanded_names_and_blocks():
    assert L.expanded_names("A_B_Phi", Treatment()) == ["A_B_Phi_sin", "A_B_Phi_cos"]
    assert L.expanded_names("A_B_Charge", Treatment())[0] == "A_B_Charge_is_-1"
    slots = L.expanded_slots(L.raw_layout(EIGHTEEN_CLASSES), Treatment())
    assert slots[0].block == "jets.pt"
    assert slots[96].block == "jets.count" and slots[96].object is None


def test_round_trips(spark, tmp_path):
    sections = L.raw_layout(EIGHTEEN_CLASSES)
    assert L.from_feature_map(L.as_feature_map(sections)) == sections
    L.write_layout(spark, sections, str(tmp_path / "layout"))
    assert L.read_layout(spark, str(tmp_path / "layout")) == sections


def test_plottable_columns():
    assert plottable(["A_B_PT", "A_B_X_Y", "A_B_Constituents", "id", "A_B"]) == {
        "A_B": ["A_B_PT", "A_B_X_Y"]
    }
