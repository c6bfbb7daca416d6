"""Short notices that no template and no training pattern contains, and sentences that name no known family."""

NOTICES = {
    "mit": [
        "This code is MIT licensed.", "Sous licence MIT", "Use of the toolkit is permitted under the MIT license.", "mylib, MIT license, 2019", "Its source is available under the MIT License on request.",
        "Copyright (c) 2021 Jane Roe. MIT License.", "Projekt steht unter der MIT-Lizenz.", "We chose the MIT licence for this module.",
    ],
    "apache-2.0": [
        "The plugin ships under Apache License 2.0.", "Dieses Werk ist unter der Apache Lizenz, Version 2.0 lizenziert.", "Apache 2.0 licensed software", "Copyright 2018 The Authors. Apache License, Version 2.0.",
        "Contributions are accepted under the Apache-2.0 license.", "Sous licence Apache 2.0", "Use it as the Apache Software License, version 2.0, allows.",
    ],
    "gpl": [
        "This module is free software under the GNU GPL.", "Copying is governed by the GNU General Public License version 3.", "Code under GPL-2.0-or-later", "You can share it under GPLv3.", "Sous licence GPL v3",
        "Ce programme est distribué sous licence GNU GPL.", "As with all of the suite, the GNU General Public License applies.", "GPL version 2 only",
    ],
    "bsd": [
        "Distributed under the BSD license", "The driver is BSD licensed.", "Sous licence BSD", "This file is under the 3-clause BSD license.", "Available as BSD-2-Clause", "A BSD-style license governs this source.",
        "The parser carries the simplified BSD licence.",
    ],
    "cc-by": [
        "Photos: CC BY 4.0", "The text is shared under Creative Commons Attribution 4.0.", "Figures are CC-BY licensed", "Contenu sous licence CC BY-SA 4.0", "Maps under the Creative Commons Attribution-ShareAlike license",
    ],
    "cc-by-nc": [
        "Slides: CC BY-NC 4.0", "Images are shared under Creative Commons Attribution-NonCommercial.", "Contenu sous licence CC BY-NC-SA 3.0", "The recordings carry a CC-BY-NC license", "Use the data as CC BY-NC permits.",
    ],
}

NO_FAMILY = [
    "GNU Lesser General Public License version 2.1", "Use is governed by the GNU Lesser General Public License.", "This server is under the GNU Affero General Public License.", "AGPLv3 licensed service", "LGPL-3.0 library",
    "Mozilla Public License Version 2.0", "Code under MPL 2.0", "The zlib license applies.", "ISC licensed", "The Unlicense", "Eclipse Public License v2.0", "Fonts: SIL Open Font License 1.1", "CC0 1.0 Universal",
    "Boost Software License 1.0", "Artwork under CC BY-ND 4.0", "Ich komme mit der Lizenz morgen vorbei.", "Das Auto fährt mit dem Licht.", "He lost his driving license in 1998.", "The public may use the general entrance.",
    "Version 2.0 of the program fixes the files.", "Fishing requires a license from the state.", "The apache helicopter landed at two.", "All distributions are normal.", "Terms and conditions may change.", "She got a new license plate.",
    "The license was granted by the ministry in version 3 of the decree.", "Creative people share commons.", "Attribution of the painting is disputed.", "GNU is a wildebeest of the plains.", "Licence to kill was released in 1989.",
]
