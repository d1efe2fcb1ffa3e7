"""Questions of known form fields, in French: fixed values, one per field name or per container and field name.

``{role}`` stands for the person or body the field is about; the second value is the type, where it is not plain text.
"""

# The question of a field by its name.
FIELD_QUESTIONS = {
    "lastName": ("Quel est le nom de famille {role} ?", None),
    "firstName": ("Quel est le prénom {role} ?", None),
    "birthDate": ("Quelle est la date de naissance {role} ? [format : JJ.MM.AAAA]", "date"),
    "ssn": ("Quel est le numéro AVS {role} ? [format : 756.XXXX.XXXX.XX]", None),
    "sex": ("Quel est le sexe {role} ? Répondre UNIQUEMENT par M (masculin) ou F (féminin).", "sex"),
    "street": ("Quelle est la rue et le numéro de l'adresse {role} ?", None),
    "zip": ("Quel est le code postal (NPA) de l'adresse {role} ?", None),
    "city": ("Quelle est la localité de l'adresse {role} ?", None),
    "phone": ("Quel est le numéro de téléphone {role} ?", None),
    "email": ("Quelle est l'adresse e-mail {role} ?", None),
    "ean": ("Quel est le numéro GLN (anciennement EAN) {role} ?", None),
    "zsr": ("Quel est le numéro RCC (ZSR) {role} ?", None),
    "blockAddress": ("Quelle est l'adresse postale complète {role} (nom, rue, NPA et localité) ?", None),
    "companyName": ("Quel est le nom de l'entreprise ou de l'institution {role} ?", None),
    "departmentName": ("Quel est le nom du service ou du département {role} ?", None),
    "insuredID": ("Quel est le numéro d'assuré du patient auprès de l'assureur ?", None),
    "caseID": ("Quel est le numéro de dossier ou de sinistre ?", None),
    "caseDate": ("Quelle est la date de l'événement assuré (accident, sinistre) ? [format : JJ.MM.AAAA]", "date"),
    "creationDate": ("Quelle est la date d'établissement du rapport ? [format : JJ.MM.AAAA]", "date"),
    "modificationDate": ("Quelle est la date de dernière mise à jour du rapport ? [format : JJ.MM.AAAA]", "date"),
    "fax": ("Quel est le numéro de fax {role} ?", None),
    "pobox": ("Quelle est la case postale de l'adresse {role} ?", None),
    "beginDate": ("Quelle est la date de début de la période concernée ? [format : JJ.MM.AAAA]", "date"),
    "endDate": ("Quelle est la date de fin de la période concernée ? [format : JJ.MM.AAAA]", "date"),
    "date": ("Quelle est la date concernée ? [format : JJ.MM.AAAA]", "date"),
    "percentWorkload": ("Quel est le taux d'activité, en pourcentage ? Répondre par le nombre seul.", "percent"),
    "percentageNum": ("Quel est le pourcentage indiqué ? Répondre par le nombre seul.", "percent"),
    "dailyWorktime": ("Quel est le temps de travail quotidien, en heures ?", None),
    "treatmentReason": ("Quel est le motif du traitement ou de la consultation ?", None),
    "input": ("Y a-t-il une remarque ou une précision à ajouter concernant les coordonnées {role} ?", None),
    "profession": ("Quelle est la profession exercée par le patient ?", None),
    "anamnesis": ("Quelle est l'anamnèse du patient : antécédents, évolution et circonstances ayant conduit à la situation actuelle ?", None),
    "remark": ("Y a-t-il une remarque particulière à signaler ?", None),
    "comment": ("Y a-t-il un commentaire à ajouter ?", None),
    "formRemark": ("Y a-t-il une remarque générale à joindre au formulaire ?", None),
    "addendum": ("Y a-t-il une information complémentaire à ajouter au rapport ?", None),
    "procedure": ("Quelle procédure ou intervention a été réalisée ou est prévue ?", None),
    "treatmentCanton": ("Dans quel canton suisse le patient est-il traité ? Répondre par le sigle du canton (VD, GE, VS, FR…).", None),
    "insuranceSelector": ("Quel est le nom de l'assureur qui prend en charge le cas ?", None),
    "condensedName": ("Quel est le nom complet {role} ?", None),
    "condensedAddress": ("Quelle est l'adresse complète {role} (rue, NPA et localité) ?", None),
    "returnToWorkFrom": ("À partir de quelle date le patient peut-il reprendre le travail ? [format : JJ.MM.AAAA]", "date"),
    "returnToWorkInWeeks": ("Dans combien de semaines une reprise du travail est-elle envisageable ? Répondre par le nombre seul.", "int"),
    "dailyAttendance": ("Combien d'heures de présence quotidienne le patient peut-il assurer ?", None),
    "dailyResilience": ("Quelle est la capacité de résistance quotidienne du patient, en heures ?", None),
    "stateOfHealth": ("Quel est l'état de santé actuel du patient ?", None),
    "changeOfDiagnosis": ("Le diagnostic a-t-il changé depuis le dernier rapport ? Si oui, préciser en quoi.", None),
    "influenceOnChangedDiagnosis": ("Quelle influence ce changement de diagnostic a-t-il sur la capacité de travail du patient ?", None),
    "degreeOnChangedDiagnosis": ("Dans quelle mesure ce changement de diagnostic modifie-t-il le pronostic ?", None),
    "changedClinicalResults": ("Quels résultats cliniques ou d'examens ont évolué depuis le dernier rapport ?", None),
    "therapeuticalMeasure": ("Quelles mesures thérapeutiques sont en cours ou prévues ?", None),
    "lastExaminationDate": ("À quelle date le patient a-t-il été examiné pour la dernière fois ? [format : JJ.MM.AAAA]", "date"),
    "progressUpdateStartDate": ("À partir de quelle date porte cette actualisation du dossier ? [format : JJ.MM.AAAA]", "date"),
    "needChangeInProfession": ("Une reconversion ou un changement d'activité professionnelle est-il nécessaire ? Si oui, préciser.", None),
    "needThirdPartyHelp": ("Le patient a-t-il besoin de l'aide d'un tiers ? Si oui, préciser pour quels actes.", None),
    "thirdPartyHelpBeginDate": ("À partir de quelle date l'aide d'un tiers est-elle nécessaire ? [format : JJ.MM.AAAA]", "date"),
    "needAdditionalClarification": ("Des investigations complémentaires sont-elles nécessaires ? Si oui, lesquelles ?", None),
    "treatmentStartDate": ("À quelle date le traitement a-t-il débuté ? [format : JJ.MM.AAAA]", "date"),
    "treatmentEndDate": ("À quelle date le traitement s'est-il terminé ou doit-il se terminer ? [format : JJ.MM.AAAA]", "date"),
    "treatmentTypes": ("Quels types de traitement sont prescrits ou en cours ?", None),
    "treatmentGoals": ("Quels sont les objectifs thérapeutiques visés ?", None),
    "numSessions": ("Combien de séances sont prescrites ? Répondre par le nombre seul.", "int"),
    "atHomeTreatment": ("Le traitement doit-il être effectué au domicile du patient ? Répondre par oui ou non.", None),
    "weekendTreatment": ("Le traitement doit-il être poursuivi le week-end ? Répondre par oui ou non.", None),
    "splintTreatment": ("Un traitement par attelle ou orthèse est-il prescrit ? Si oui, préciser.", None),
    "hoursPerDayPlanned": ("Combien d'heures par jour le traitement est-il prévu ?", None),
    "evaluation": ("Quelle est l'appréciation médicale de la situation du patient ?", None),
    "request": ("Quelle est la demande adressée à l'assureur ou à l'office ?", None),
    "attachment": ("Quels documents sont joints au rapport ?", None),
    "fillerName": ("Qui a rempli ce formulaire ? Indiquer le nom de la personne.", None),
    "accidentDate": ("À quelle date l'accident est-il survenu ? [format : JJ.MM.AAAA]", "date"),
    "accidentDescription": ("Comment l'accident s'est-il produit ? Décrire les circonstances.", None),
    "firstTreatmentDate": ("À quelle date le patient a-t-il été traité pour la première fois ? [format : JJ.MM.AAAA]", "date"),
    "prognosis": ("Quel est le pronostic pour ce patient ?", None),
    "findings": ("Quelles sont les constatations cliniques ?", None),
    "diagnosis": ("Quel est le diagnostic posé ?", None),
    "diagDescription": ("Quels sont les diagnostics retenus, avec pour chacun la date depuis laquelle il existe ? Lister toutes les entrées, une par ligne.", None),
    "lastTreatment": ("À quelle date remonte le dernier examen ou la dernière consultation ? [format : JJ.MM.AAAA]", "date"),
    "report": ("Quel est le constat médical : examen clinique, résultats d'examens complémentaires et éléments objectifs relevés ?", None),
    "therapy": ("Quelle thérapie est mise en place ?", None),
    "medication": ("Quels médicaments le patient prend-il ?", None),
    "hospitalisationFrom": ("À partir de quelle date le patient est-il hospitalisé ? [format : JJ.MM.AAAA]", "date"),
    "hospitalisationTo": ("Jusqu'à quelle date le patient est-il hospitalisé ? [format : JJ.MM.AAAA]", "date"),
    "workIncapacityFrom": ("À partir de quelle date le patient est-il en incapacité de travail ? [format : JJ.MM.AAAA]", "date"),
    "workIncapacityTo": ("Jusqu'à quelle date l'incapacité de travail est-elle attestée ? [format : JJ.MM.AAAA]", "date"),
    "workIncapacityDegree": ("Quel est le taux d'incapacité de travail, en pourcentage ? Répondre par le nombre seul.", "percent"),
    "firstTreatmentCity": ("Dans quelle localité le premier traitement a-t-il eu lieu ?", None),
    "firstTreatmentTime": ("À quelle heure le premier traitement a-t-il eu lieu ? [format : HH:MM]", None),
    "firstTreatmentDoctor": ("Quel médecin a assuré le premier traitement ?", None),
    "firstTreatmentSpeciality": ("Quelle est la spécialité du médecin ayant assuré le premier traitement ?", None),
    "firstIncidence": ("Quand les premiers symptômes sont-ils apparus ?", None),
    "previousTreatments": ("Quels traitements le patient a-t-il déjà reçus pour cette affection ?", None),
    "hasPreviousTreatments": ("Le patient a-t-il déjà été traité pour cette affection ? Répondre par oui ou non.", None),
    "previousTherapies": ("Quelles thérapies ont déjà été tentées ?", None),
    "previousDiseases": ("Quels antécédents médicaux le patient présente-t-il ?", None),
    "patientIndications": ("Quelles plaintes le patient rapporte-t-il lui-même ?", None),
    "anamnesisOther": ("Y a-t-il d'autres éléments d'anamnèse à signaler ?", None),
    "morphologicalDamage": ("Quelles atteintes morphologiques sont constatées (lésions, déformations) ?", None),
    "functionalDamage": ("Quelles atteintes fonctionnelles sont constatées (limitations de mobilité, de force) ?", None),
    "exams": ("Quels examens complémentaires ont été réalisés et avec quels résultats ?", None),
    "objectiveLimitation": ("Quelles limitations objectives l'examen met-il en évidence ?", None),
    "currentSituation": ("Quelle est la situation actuelle du patient ?", None),
    "hasOtherFactors": ("D'autres facteurs influencent-ils l'évolution ? Répondre par oui ou non.", None),
    "otherFactors": ("Quels autres facteurs influencent l'évolution du cas (contexte professionnel, social, psychique) ?", None),
    "nationality": ("Quelle est la nationalité du patient ?", None),
    "workHours": ("Quel est l'horaire de travail habituel du patient ?", None),
    "workingHours": ("Quel est l'horaire de travail habituel du patient ?", None),
    "workingDays": ("Combien de jours par semaine le patient travaille-t-il habituellement ?", None),
    "reason": ("Quel est le motif de ce rapport ?", None),
    "pregnancyDueDate": ("Quelle est la date prévue de l'accouchement ? [format : JJ.MM.AAAA]", "date"),
    "hospitalisationList": ("Dans quels établissements le patient a-t-il été hospitalisé, et à quelles dates ?", None),
    "hospitalisationChoice": ("Le patient a-t-il été hospitalisé ? Répondre par oui ou non.", None),
    "otherInvolvedDoctor": ("Quel autre médecin est intervenu dans la prise en charge ?", None),
    "otherInvolvedSpeciality": ("Quelle est la spécialité de cet autre médecin intervenant ?", None),
    "otherInvolvedCity": ("Dans quelle localité cet autre médecin exerce-t-il ?", None),
    "otherInvolvedDate": ("À quelle date cet autre médecin est-il intervenu ? [format : JJ.MM.AAAA]", "date"),
    "hasOtherInsurer": ("Un autre assureur est-il concerné par ce cas ? Répondre par oui ou non.", None),
    "otherInsurerList": ("Quels autres assureurs sont concernés par ce cas ?", None),
    "nextTreatmentDate": ("Quelle est la date du prochain traitement prévu ? [format : JJ.MM.AAAA]", "date"),
    "treatmentDateList": ("Quelles sont les dates des traitements effectués ?", None),
    "treatmentDuration": ("Quelle est la durée prévue du traitement ?", None),
    "treatmentProblem": ("Quel problème le traitement doit-il résoudre ?", None),
    "examinationDate": ("À quelle date le patient a-t-il été examiné ? [format : JJ.MM.AAAA]", "date"),
    "accidentDetails": ("Quelles sont les circonstances détaillées de l'accident ?", None),
    "accidentTime": ("À quelle heure l'accident est-il survenu ? [format : HH:MM]", None),
    "courseOfAccident": ("Comment l'accident s'est-il déroulé ?", None),
    "classification": ("Quelle est la classification retenue pour cette atteinte ?", None),
    "aidsDescription": ("Quels moyens auxiliaires sont demandés ? Les décrire précisément.", None),
    "physioGoals": ("Quels sont les objectifs de la physiothérapie ?", None),
    "physioMethods": ("Quelles méthodes de physiothérapie sont prescrites ?", None),
    "mdRecommendation": ("Quelle est la recommandation du médecin ?", None),
    "course": ("Quelle a été l'évolution du cas depuis le dernier rapport ?", None),
    "ask4FormerProlapses": ("Le patient a-t-il déjà présenté des rechutes de cette affection ? Répondre UNIQUEMENT par oui ou non.", None),
    "formerProlapses": ("Quelles rechutes le patient a-t-il déjà présentées, et à quelles dates ?", None),
    "recommendation": ("Quelle recommandation formulez-vous pour la suite de la prise en charge ?", None),
    "consultationInterval": ("À quel intervalle les consultations de suivi sont-elles prévues ?", None),
    "therapyLength": ("Quelle est la durée prévue de la thérapie ?", None),
    "ask4NewWorkplace": ("Une adaptation du poste de travail est-elle nécessaire ? Répondre UNIQUEMENT par oui ou non.", None),
    "ask4LastingHandicap": ("Une atteinte durable à l'intégrité est-elle à prévoir ? Répondre UNIQUEMENT par oui ou non.", None),
    "handicap": ("Quelle atteinte durable à l'intégrité est à prévoir ?", None),
    "poBox": ("Quelle est la case postale de l'adresse ?", None),
    "geschlecht": ("Quel est le sexe du patient ? Répondre UNIQUEMENT par la lettre M (masculin) ou F (féminin).", "sex"),
    "hoursPerDayFixed": ("Combien d'heures par jour le patient peut-il travailler ?", None),
    "hoursPerDayFix": ("Combien d'heures par jour le patient peut-il travailler ?", None),
    "returnBeforeWeekend": ("Le patient peut-il reprendre le travail avant le week-end ? Répondre par oui ou non.", None),
    "DiagnosesUnemployabilityRelated": ("Quels diagnostics justifient l'incapacité de travail ?", None),
    "DiagnosesUnemployabilityUnrelated": ("Quels diagnostics n'ont pas d'incidence sur la capacité de travail ?", None),
    "impossibleActivities": ("Quelles activités le patient ne peut-il plus exercer ?", None),
    "possibleActivities": ("Quelles activités le patient peut-il encore exercer ?", None),
    "generalCondition": ("Quel est l'état général du patient ?", None),
    "proposedTherapy": ("Quelle thérapie proposez-vous ?", None),
    "recipientBlockAddressLeft": ("Quelle est l'adresse complète de l'organisme destinataire du rapport (nom, rue, NPA et localité) ? Elle correspond au canton de traitement du patient.", None),
    "recipientBlockAddressRight": ("Quelle est l'adresse complète du service ou de la personne destinataire du rapport, si elle diffère de l'organisme principal (nom, rue, NPA et localité) ?", None),
}

# The question of a field by its container and name, asked before the name alone.
CONTEXT_QUESTIONS = {
    ("lawS1Struct", "type"): ("De quel régime d'assurance relève la prise en charge ? Répondre UNIQUEMENT par LAA (accident), LaMal (assurance de base), LCA (assurance complémentaire) ou LAM (assurance militaire).", None),
    ("documentS1Struct", "title"): ("Quel est l'intitulé du document annexé au rapport ?", None),
    ("documentS1Struct", "type"): ("De quel type de document s'agit-il ?", None),
    ("diagnosisS1Struct", "code"): ("Quel est le code CIM-10 du diagnostic ? Reprendre le code exactement tel qu'il figure dans les documents, sans le reformuler.", None),
    ("diagnosisS1Struct", "name"): ("Quel est le libellé du diagnostic posé ?", None),
    ("diagnosisS1Struct", "date"): ("À quelle date ce diagnostic a-t-il été posé ? [format : JJ.MM.AAAA]", "date"),
    ("diagnosisS1Struct", "remark"): ("Y a-t-il une précision à apporter sur ce diagnostic ?", None),
    ("employerS1Address", "nif"): ("Quel est le numéro d'identification de l'entreprise (IDE/NIF) de l'employeur ?", None),
    ("consumerS1Address", "title"): ("Quel est le titre ou la civilité du destinataire du formulaire (Dr, Prof., Madame, Monsieur) ?", None),
    ("lawS1Struct", "input"): ("Y a-t-il une précision à apporter sur la couverture d'assurance (régime applicable, réserve, prise en charge particulière) ?", None),
    ("treatmentS1Struct", "input"): ("Y a-t-il une précision à apporter sur le lieu ou le contexte du traitement (établissement, service, cadre ambulatoire ou hospitalier) ?", None),
    ("documentS1Struct", "input"): ("Y a-t-il une remarque à joindre au sujet des documents annexés ?", None),
    ("diagnosisS1Struct", "input"): ("Y a-t-il une précision à apporter sur le diagnostic ?", None),
    ("diagnosisS1Struct", "type"): ("Quel système de codage est employé pour cette entrée ? Répondre UNIQUEMENT par ICD (diagnostic), CHOP (intervention) ou FreeText (texte libre).", None),
    ("unemployabilityS1Struct", "input"): ("Y a-t-il une précision à apporter sur cette période d'incapacité de travail ?", None),
    ("cardS1Struct", "input"): ("Y a-t-il une remarque concernant la carte d'assuré ?", None),
    ("cardS1Struct", "cardID"): ("Quel est le numéro de la carte d'assuré du patient ?", None),
    ("anamnesisStruct", "input"): ("Y a-t-il une précision à apporter sur l'anamnèse ?", None),
    ("therapyStruct", "input"): ("Y a-t-il une précision à apporter sur la thérapie ?", None),
    ("anamnesisStruct", "morphologicalFinding"): ("Quelles sont les constatations morphologiques à l'examen (lésions, tuméfactions, déformations) ?", None),
    ("anamnesisStruct", "functionalFinding"): ("Quelles sont les constatations fonctionnelles à l'examen (mobilité, force, limitations) ?", None),
    ("anamnesisStruct", "xray"): ("Quels sont les résultats des examens radiologiques ?", None),
    ("generalConditionStruct", "ask4specialPerception"): ("L'état général du patient présente-t-il une particularité à signaler ? Répondre UNIQUEMENT par oui ou non.", None),
    ("generalConditionStruct", "specialPerception"): ("Quelle est la particularité constatée dans l'état général du patient ?", None),
    ("therapyStruct", "ask4Hospitalization"): ("Le patient a-t-il été hospitalisé ? Répondre UNIQUEMENT par oui ou non.", None),
}
