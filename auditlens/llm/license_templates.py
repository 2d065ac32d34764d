"""Licence notices by family, sentences that only sound like them, and the labelled sample made of both."""

from __future__ import annotations

import random

#: Notices as their licences word them (fixed values).
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.", "Distributed under the GNU GPL v2.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "Released under the LGPL.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
        "You should have received a copy of the GNU Affero General Public License along with this program.", "Released under the AGPL.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.", "Licensed under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at", "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
        "Content is available under the Creative Commons Attribution License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC0": (
        "Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0",
    ),
}
UNKNOWN = "unknown"
#: Sentences of other matters that share words with notices.
OTHERS = (
    "He renewed his driving licence at the office in town.", "The licence plate of the car was never found.", "A fishing license costs ten pounds a year.",
    "The university granted permission to publish the letters.", "Version 2.0 of the program was released in May.", "All rights reserved by the hotel for its guests.",
    "The MIT campus lies on the river.", "Students of MIT presented their work.", "An Apache helicopter flew over the hills.", "The Apache people lived in the south west.",
    "The general public was not admitted.", "The GNU project began a long time ago.", "A lesser known public house stood there.", "Free software is discussed in chapter three.",
    "Copyright law differs between countries.", "The software is distributed by post without charge.", "The terms of the contract were agreed to in writing.",
    "You may not use this door except in an emergency.", "See the map for the specific route.", "Creative work is common in schools.", "Attribution of the painting is disputed.",
    "The commons are open to all villagers.", "Mozilla is a name that many readers know.", "The source of the river is a form of spring.", "Redistribution of land was the law's aim.",
    "The bank holds a license to trade in the city.", "This work was commissioned by the king.", "The library is open to the public on Sundays.", "The BSD committee met on Monday.",
    "He was licensed to practise medicine.", "The restaurant lost its license to sell wine.", "They released the birds under the old oak.", "The version for piano was published later.",
    "International trade grew by four percent.", "A public domain of the crown stretched to the sea.", "This program is broadcast on Tuesday.", "You should have received a letter by now.",
    "Permission is required to enter the garden.", "A copy of the book was sold at auction.", "The author has waived his fee for the evening.", "The binary star was first seen from there.",
    "Unless required, the form need not be signed.", "Universal agreement was not to be had.", "CC the letter to the office by Friday.", "by nc road the distance is shorter", "the sa region in 4.0 metres of snow",
)
#: Notices of licences that are no family here: unknown. The sample holds these (fixed values).
FOREIGN = (
    "Licensed under the Eclipse Public License 2.0.", "This program is made available under the terms of the Eclipse Public License v1.0.", "SPDX-License-Identifier: EPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License.",
    "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Licensed under the zlib license.",
    "Licensed under the Common Development and Distribution License, Version 1.0.", "This work is licensed under the Open Font License.", "SPDX-License-Identifier: OFL-1.1",
    "Licensed under the Microsoft Public License.", "Released under the Do What The Fuck You Want To Public License.",
)
#: More such notices, which are not trained on: the least probability is set on them.
UNSEEN = (
    "Licensed under the European Union Public Licence 1.2.", "Released under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0", "SPDX-License-Identifier: EUPL-1.2",
    "Licensed under the Academic Free License, version 3.0.", "This work is licensed under the Free Art License 1.3.", "Released under the PostgreSQL License.",
    "This program is licensed under the Q Public License, version 1.0.", "Licensed under the Common Public License 1.0.", "Licensed under the Open Software License, version 3.0.",
)
#: What families are called, and short wordings round a name; the sample holds these too, templates do not (fixed values).
NAMES = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache", "Apache 2.0"), "GPL": ("GPL", "GPLv3", "GPLv2"), "LGPL": ("LGPL",), "AGPL": ("AGPL",), "BSD": ("BSD", "BSD 2-Clause"),
    "MPL-2.0": ("MPL 2.0", "Mozilla Public License"), "CC-BY": ("CC BY 4.0",), "CC-BY-SA": ("CC BY-SA 4.0",), "CC-BY-NC": ("CC BY-NC 4.0",), "CC0": ("CC0",),
}
SHORT = ("License: {}", "Licence: {}", "licensed under {}", "{}-licensed", "code under the {} license", "(c) the authors, {}")
#: Everyday words for the prose round a notice.
FILLER = ("the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him "
          "been has when who will no more if out so said what up its about into than them can only other time new some could these two may first then do any like my now over such "
          "der die und das ist nicht ein eine zu den von mit le la les des et est une que dans pour el los las una con por para del en os ar an er th on in re ti st en").split()
SAMPLE = 60


def labelled(seed: int = 7, per_template: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, family) rows, `per_template` for each notice and a third of that for each foreign one and each other sentence; the sample's bound."""
    r = random.Random(seed)
    prose = lambda n: " ".join(r.choice(FILLER) + r.choice(("", "", "", "", ",", ".")) for _ in range(r.randint(0, n)))
    rows = []

    def vary(text: str) -> str:
        w = text.split()
        if len(w) > 14 and r.random() < 0.4:
            at = r.randint(0, len(w) - 11)
            w = w[at:at + r.randint(11, len(w))]
        if len(w) > 6 and r.random() < 0.2:
            w.pop(r.randrange(len(w)))
        out = " ".join(w)
        out = r.choice((out, out, out.upper(), out.lower(), out.rstrip(".")))
        return f"{prose(12)} {out} {prose(12)}" if r.random() < 0.4 else out

    for family, texts in TEMPLATES.items():
        for t in texts:
            rows += [(vary(t), family) for _ in range(per_template)]
    for t in FOREIGN:
        rows += [(vary(t), UNKNOWN) for _ in range(per_template // 3)]
    for t in OTHERS:
        rows += [(vary(t), UNKNOWN) for _ in range(per_template // 3)]
    rows += [(prose(60), UNKNOWN) for _ in range(per_template * 10)]
    r.shuffle(rows)
    return rows


def short(seed: int = 8, per_name: int = SAMPLE // 4) -> list[tuple[str, str]]:
    """(text, family) rows of short wordings, `per_name` for each name in each: they belong to the sample, but no template confirms them."""
    r = random.Random(seed)
    prose = lambda: " ".join(r.choice(FILLER) for _ in range(r.randint(0, 12)))
    plain = [(wording.format(name), family) for family, names in NAMES.items() for name in names for wording in SHORT for _ in range(per_name)]
    rows = [(f"{prose()} {r.choice((t, t, t.lower(), t.upper()))} {prose()}" if r.random() < 0.4 else t, f) for t, f in plain]
    r.shuffle(rows)
    return rows
