"""Published evaluation results of three model stages, as expected input and output of the analysis."""

# --- fixed values: recorded metrics, dates, and the comparison made from them -------------------
BASE = {
    "arc_challenge": {
        "alias": "arc_challenge",
        "acc,none": 0.4812286689419795,
        "acc_stderr,none": 0.014601090150633966,
        "acc_norm,none": 0.5162116040955631,
        "acc_norm_stderr,none": 0.01460370856741494,
    },
    "commonsense_qa": {
        "alias": "commonsense_qa", "acc,none": 0.8271908271908271, "acc_stderr,none": 0.010824462376464382,
    },
    "gsm8k": {
        "alias": "gsm8k",
        "exact_match,strict-match": 0.7543593631539045,
        "exact_match_stderr,strict-match": 0.011857183603902227,
        "exact_match,flexible-extract": 0.8514025777103866,
        "exact_match_stderr,flexible-extract": 0.00979750318052789,
    },
    "hellaswag": {
        "alias": "hellaswag",
        "acc,none": 0.5452101175064729,
        "acc_stderr,none": 0.004969341773423505,
        "acc_norm,none": 0.7364070902210715,
        "acc_norm_stderr,none": 0.004396806562351264,
    },
    "winogrande": {
        "alias": "winogrande", "acc,none": 0.7032359905288083, "acc_stderr,none": 0.012839239695202023,
    },
}
SFT = {
    "arc_challenge": {
        "alias": "arc_challenge",
        "acc,none": 0.5418088737201365,
        "acc_stderr,none": 0.014560220308714697,
        "acc_norm,none": 0.5853242320819113,
        "acc_norm_stderr,none": 0.014397070564409172,
    },
    "commonsense_qa": {
        "alias": "commonsense_qa", "acc,none": 0.814086814086814, "acc_stderr,none": 0.011138085349810685,
    },
    "gsm8k": {
        "alias": "gsm8k",
        "exact_match,strict-match": 0.7854435178165277,
        "exact_match_stderr,strict-match": 0.011307604104052887,
        "exact_match,flexible-extract": 0.7846853677028052,
        "exact_match_stderr,flexible-extract": 0.011322096294579665,
    },
    "hellaswag": {
        "alias": "hellaswag",
        "acc,none": 0.581557458673571,
        "acc_stderr,none": 0.004922953651577669,
        "acc_norm,none": 0.7573192591117307,
        "acc_norm_stderr,none": 0.004278274767424337,
    },
    "winogrande": {
        "alias": "winogrande", "acc,none": 0.6898184688239937, "acc_stderr,none": 0.013000454144859891,
    },
}
DPO = {
    "arc_challenge": {
        "alias": "arc_challenge",
        "acc,none": 0.5469283276450512,
        "acc_stderr,none": 0.01454689205200563,
        "acc_norm,none": 0.5708191126279863,
        "acc_norm_stderr,none": 0.014464085894870657,
    },
    "commonsense_qa": {
        "alias": "commonsense_qa", "acc,none": 0.7993447993447993, "acc_stderr,none": 0.011466011466011556,
    },
    "gsm8k": {
        "alias": "gsm8k",
        "exact_match,strict-match": 0.7952994692949203,
        "exact_match_stderr,strict-match": 0.011113916396062962,
        "exact_match,flexible-extract": 0.8483699772554966,
        "exact_match_stderr,flexible-extract": 0.009879331091354316,
    },
    "hellaswag": {
        "alias": "hellaswag",
        "acc,none": 0.6191993626767576,
        "acc_stderr,none": 0.004845912857338662,
        "acc_norm,none": 0.7887870942043418,
        "acc_norm_stderr,none": 0.0040733491761333306,
    },
    "winogrande": {
        "alias": "winogrande", "acc,none": 0.6787687450670876, "acc_stderr,none": 0.013123599324558307,
    },
}
DATES = {"base_early": 1767170087.924798, "base": 1767173238.2431905, "sft": 1767174910.4724839, "dpo": 1767175834.4936323}
SAMPLES = {"arc_challenge": 1172, "commonsense_qa": 1221, "gsm8k": 1319, "winogrande": 1267, "hellaswag": 10042}
METRICS = {
    "base": {
        "arc_challenge": 0.4812286689419795, "commonsense_qa": 0.8271908271908271, "gsm8k": 0.7543593631539045,
        "hellaswag": 0.5452101175064729, "winogrande": 0.7032359905288083,
    },
    "sft": {
        "arc_challenge": 0.5418088737201365, "commonsense_qa": 0.814086814086814, "gsm8k": 0.7854435178165277,
        "hellaswag": 0.581557458673571, "winogrande": 0.6898184688239937,
    },
    "dpo": {
        "arc_challenge": 0.5469283276450512, "commonsense_qa": 0.7993447993447993, "gsm8k": 0.7952994692949203,
        "hellaswag": 0.6191993626767576, "winogrande": 0.6787687450670876,
    },
}
COMPARISON = [
    "task,base,sft,dpo,sft_vs_base,dpo_vs_sft",
    "arc_challenge,48.12,54.18,54.69,+6.1%,+0.5%",
    "commonsense_qa,82.72,81.41,79.93,-1.3%,-1.5%",
    "gsm8k,75.44,78.54,79.53,+3.1%,+1.0%",
    "hellaswag,54.52,58.16,61.92,+3.6%,+3.8%",
    "winogrande,70.32,68.98,67.88,-1.3%,-1.1%",
]
AVERAGES = {"base": "66.22", "sft": "68.25", "dpo": "68.79"}
GAINS = ["+2.03%", "+0.54%"]
# -------------------------------------------------------------------------------------------------


def document(results, date):
    counts = {t: {"original": n, "effective": n} for t, n in SAMPLES.items()}
    return {"results": results, "n-samples": counts, "date": date}
