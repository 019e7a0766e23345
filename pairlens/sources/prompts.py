"""Conversations that ask a model to decide and to explain; ``{feature}``, ``{ltuple}``, ``{rtuple}`` and the like are filled in."""

ROLE = ("system", "You decide whether two records describe the same thing, and say why.")
QUESTION = ("user", "record1: {ltuple}\nrecord2: {rtuple}")
ONE_SHOT = [
    ROLE,
    ("user", "Answer with one JSON object of three keys. same_entity: yes or no. saliency_explanation: for each {feature}, prefixed with ltable_ for record1 and rtable_ for record2, how much it mattered, from 0 to 1. "
     "counterfactual_explanation: both records with as few {feature}s changed as would turn your decision."),
    ("assistant", "Show me the records."),
]
DECIDE = [ROLE, ("user", "Answer yes if the two records match, and no if they do not."), ("assistant", "Show me the records.")]
AGAIN = ("user", "Does that mean yes or no?")
WHY = ("user", "Why?")
SALIENCY = ("user", "Give the saliency of each {feature} from 0 to 1, as a JSON object; prefix record1's with ltable_ and record2's with rtable_.")
COUNTERFACTUAL = ("user", "Give both records, as JSON objects record1 and record2, with as few {feature}s changed as would turn your decision.")
FEW_SHOT = [("human", "record1:{ltuple}\nrecord2:{rtuple}"), ("ai", "prediction:{prediction}, saliency:{saliency}, counterfactual:{cf}")]
JUDGE = [("user", "Two systems explain why record1 {ltuple} and record2 {rtuple} were decided as {prediction}. system1: {explanation1} system2: {explanation2} Which explanation is better: system1, system2, or none?")]
